"""Operator 9: byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
token as it stands costs one probe. Tier two merges the rest with a heap of
pair ranks over a doubly linked list of bytes.

Texts are cut at spaces that a visible character follows. The pre-token
pattern can't match across such a cut, and looks at nothing before it, so each
piece has the same ids in every text; a bounded memo keeps them per worker.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, require, slices

#: What could be white space or invisible in some version of Unicode.
_UNSURE = "\\x00-\\x20\\x7f-\\xa0\\xad\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
#: Texts where an unsure character or the end follows a space are cut by a slower exact rule.
_ODD_SPACE = re.compile(f"\\x20(?:[{_UNSURE}]|\\Z)")
_CUT = re.compile(f"\\x20(?=[^{_UNSURE}])")


def cut(text: str) -> list[str]:
    """Pieces of text; joined by single spaces they give it back."""
    return _CUT.split(text) if _ODD_SPACE.search(text) else text.split("\x20")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Keys fall into buckets by one half of a 64-bit hash; each bucket, largest
    first, gets the first displacement that sends its keys to free slots.
    There are as many slots as keys. A probe compares the stored key, so
    strings outside the set are told apart exactly.
    """

    def __init__(self, values: dict[bytes, int], per_bucket: int = 2):
        keys = list(values)
        n = self.size = max(1, len(keys))
        self.buckets = max(1, n // per_bucket)
        for seed in range(64):
            if self._build(keys, n, seed):
                break
        else:
            raise ValueError("no perfect hash found")
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        for k in keys:
            s = self.slot(k)
            self.keys[s], self.values[s] = k, values[k]

    def _build(self, keys: list[bytes], n: int, seed: int) -> bool:
        self.seed = seed
        groups: dict[int, list[tuple[int, int]]] = {}
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k, seed)
            groups.setdefault((h >> 40) % self.buckets, []).append((h & 0xFFFFF, (h >> 20 & 0xFFFFF) | 1))
        self.shift = [(0, 0)] * self.buckets
        free = bytearray(b"\1") * n
        last = 0
        for b, pairs in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(pairs) == 1:  # any free slot will do
                last = free.index(1, last)
                free[last] = 0
                self.shift[b] = ((last - pairs[0][0]) % n, 0)
                continue
            if len(set(pairs)) < len(pairs):
                return False
            for d in range(8 * n):
                add, times = d % n, d // n
                slots = {(x + times * y + add) % n for x, y in pairs}
                if len(slots) == len(pairs) and all(map(free.__getitem__, slots)):
                    for s in slots:
                        free[s] = 0
                    self.shift[b] = (add, times)
                    break
            else:
                return False
        return True

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        add, times = self.shift[(h >> 40) % self.buckets]
        return ((h & 0xFFFFF) + times * ((h >> 20 & 0xFFFFF) | 1) + add) % self.size

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        s = self.slot(key)
        return self.values[s] if self.keys[s] == key else -1


class Encoder:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str, memo_limit: int = 300_000):
        ranks = load_ranks(path)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.perfect = PerfectHash(ranks)
        self.single = [ranks[bytes([i])] for i in range(256)]
        # Two neighbours may merge if their bytes together are a token; its rank decides.
        self.pair = {
            ranks[t[:i]] << 20 | ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.byte_pair = [self.pair.get(a << 20 | b, -1) for a in self.single for b in self.single]
        self.find = regex.compile(pattern).findall
        self.memo = Memo(lambda p: self.piece("\x20" + p), memo_limit)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost among equals."""
        n, get, push, pop = len(word), self.pair.get, heapq.heappush, heapq.heappop
        first = self.byte_pair
        # Rank of the pair that begins at each place now; what the heap holds besides is out of date.
        now = [first[a << 8 | b] for a, b in zip(word, word[1:])]
        heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        ids = [self.single[b] for b in word]
        if not heap:
            return ids
        heapq.heapify(heap)
        now.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if now[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], now[j] = rank, -1, -1
            if k < n:
                before[k] = i
                r = now[i] = get(rank << 20 | ids[k], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = now[h] = get(ids[h] << 20 | rank, -1)
                if r >= 0:
                    push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        for token in self.find(text):
            raw = token.encode("utf-8")
            known = self.perfect.get(raw)
            if known >= 0:
                out.append(known)
            else:
                out += self.merge(raw)
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        pieces = cut(text)
        return self.piece(pieces[0]) + b"".join(map(self.memo.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text; one row (id_col, n_tokens, ids) per input row.

    ids holds little-endian unsigned 32-bit integers. path names a .tiktoken
    file that every executor has; it is a parameter and is never copied. No
    shuffle. A null or empty text has no ids; very long texts are encoded
    whole. Special tokens are ordinary text. Pairs of equal rank merge from the
    left. Other columns, whatever their names, are not read. Repeated rows
    stay; an empty table gives no rows.
    """
    require(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [enc.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=[id_col, "n_tokens", "ids"],
                )

    key = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {key}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id") -> DataFrame:
    """Add decoded (binary) to rows of encode_documents.

    Null and empty ids decode to no bytes; repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    require(encoded, id_col, "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch):
                raw = [enc.decode(x) if x else b"" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(raw, pa.binary())],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )

    key = encoded.select(id_col).dtypes[0][1]
    return encoded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {key}, n_tokens long, ids binary, decoded binary")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all documents, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
