"""Scalar helpers for predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob with *, ?, [set] and backslash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("^", "\\^").replace("[", "\\[").replace("&", "\\&") + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def string_match(column: Column, pattern: str) -> Column:
    """Whether a string matches a glob pattern."""
    return column.rlike(glob_regex(pattern))
