"""Streams: stateless operators take them, the others refuse."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import StreamingNotSupported

#: Operators that need one tuple at a time.
STATELESS = ("restrict", "restrictwith", "extend", "rename", "wrap", "unwrap")


def whole(df: DataFrame, operator: str) -> DataFrame:
    """df, unless it is a stream and the operator has to see all of it."""
    if df.isStreaming and operator not in STATELESS:
        raise StreamingNotSupported(operator)
    return df
