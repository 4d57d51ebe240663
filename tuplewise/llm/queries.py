"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op9_byte_bpe
from .chat import op7_chat_format
from .lm_score import op6_lm_score
from .near_dup import op10_minhash_near_dup
from .oracle import SQL
from .packing import op1_best_fit_packing
from .quality import op5_quality_rules
from .secrets import op3_secret_scan
from .substring_dup import op4_substring_dedup
from .top_k import op2_exact_top_k
from .url_rules import op8_url_filter

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_score": op6_lm_score,
    "op7_chat_format": op7_chat_format,
    "op8_url_filter": op8_url_filter,
    "op10_minhash_near_dup": op10_minhash_near_dup,
    "op9_byte_bpe": op9_byte_bpe,
}

__all__ = ["QUERIES", "SQL"]
