"""Aggregate functions of summarize: each knows its value over no tuples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import canonical, nested_tuple, quoted


@dataclass(frozen=True)
class Aggregate:
    """build(type of the attribute) gives the column; empty is its value over no tuples, if it has one."""

    build: Callable[[T.DataType | None], Column]
    empty: object = None
    attribute: str | None = None


_WIDE = (T.IntegerType, T.ShortType, T.ByteType)


def _sum(kind: T.DataType | None, column: Column, distinct: bool = False) -> Column:
    """Integers add up without overflow: int in long, long in decimal."""
    if isinstance(kind, T.LongType):
        column = column.cast("decimal(38,0)")
    elif isinstance(kind, _WIDE):
        column = column.cast("long")
    return F.sum_distinct(column) if distinct else F.sum(column)


def _mean(kind: T.DataType | None, total: Column, count: Column) -> Column:
    """Integers floor, as their division does in the host language."""
    if isinstance(kind, (*_WIDE, T.LongType)):
        whole = total.cast("decimal(38,0)")
        return ((whole - F.pmod(whole, count.cast("decimal(20,0)"))) / count).cast("decimal(38,0)")
    return total / count


def rcount() -> Aggregate:
    """Number of tuples."""
    return Aggregate(lambda _: F.count(F.lit(1)), 0)


def rcountd(attr: str) -> Aggregate:
    """Number of distinct values, exactly."""
    return Aggregate(lambda _: F.count_distinct(quoted(attr)), 0, attr)


def rsum(attr: str) -> Aggregate:
    """Sum; 0 over no tuples."""
    return Aggregate(lambda k: F.coalesce(_sum(k, quoted(attr)), F.lit(0)), 0, attr)


def rsumd(attr: str) -> Aggregate:
    """Sum of distinct values; 0 over no tuples."""
    return Aggregate(lambda k: F.coalesce(_sum(k, quoted(attr), True), F.lit(0)), 0, attr)


def ravg(attr: str) -> Aggregate:
    """Mean; floored for integers. Undefined over no tuples."""
    return Aggregate(lambda k: _mean(k, _sum(k, quoted(attr)), F.count(quoted(attr))), None, attr)


def ravgd(attr: str) -> Aggregate:
    """Mean of distinct values; floored for integers. Undefined over no tuples."""
    return Aggregate(lambda k: _mean(k, _sum(k, quoted(attr), True), F.count_distinct(quoted(attr))), None, attr)


def rmin(attr: str) -> Aggregate:
    """Smallest value. Undefined over no tuples."""
    return Aggregate(lambda _: F.min(quoted(attr)), None, attr)


def rmax(attr: str) -> Aggregate:
    """Largest value. Undefined over no tuples."""
    return Aggregate(lambda _: F.max(quoted(attr)), None, attr)


def count_where(condition: Column | str) -> Aggregate:
    """Number of tuples for which the condition holds."""
    return Aggregate(lambda _: F.count_if(F.expr(condition) if isinstance(condition, str) else condition), 0)


def rrelation(*attrs: str) -> Aggregate:
    """The sub-relation over these attributes, as a nested relation."""
    return Aggregate(lambda _: canonical(F.collect_set(nested_tuple(list(attrs)))), [])


def aggregate(column: Column, empty: object = None) -> Aggregate:
    """Any aggregate column."""
    return Aggregate(lambda _: column, empty)


def rfold(function: Callable, kind: T.DataType | str, attr: str, empty: object = None) -> Aggregate:
    """An aggregate function of the host language over the pandas Series of one attribute.

    It sees whole groups, so each has to fit a worker; built-in aggregates don't need that.
    """

    def build(_: T.DataType | None) -> Column:
        import pandas as pd

        def whole(values):
            return function(values)

        whole.__annotations__ = {"values": pd.Series, "return": float}  # one value for a series
        return F.pandas_udf(whole, kind)(quoted(attr))

    return Aggregate(build, empty, attr)
