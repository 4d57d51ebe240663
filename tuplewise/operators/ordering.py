"""Rank and tag without a single-partition window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import write_scratch
from ..types import quoted


def competition_rank(df: DataFrame, attr: str, new: str, descending: bool) -> DataFrame:
    """Add 1 + the number of tuples with a smaller (larger) value, as long.

    Values are counted first. Their counts are range-partitioned, each
    partition's sum gives where it starts, and the ranks of values join back:
    no task sees all tuples, and no window spans more than a range.
    """
    value = quoted(attr)
    counts = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = number(counts, [F.col("_v").desc() if descending else F.col("_v").asc()], "_r", F.col("_n"))
    ranks = placed.select("_v", (F.col("_r") + 1).alias(new))
    return df.join(ranks, value.eqNullSafe(F.col("_v"))).drop("_v")


def number(df: DataFrame, order: list[Column], new: str, weight: Column | None = None) -> DataFrame:
    """Add the sum of weights (default 1) of all rows before, in a total order, as long.

    Rows are range-partitioned in that order; a window runs within each
    partition, and a running sum of the partitions' totals shifts it. The
    partitioned rows are written to the shared folder, as both steps need the
    same partitions.
    """
    weight = F.lit(1) if weight is None else weight
    ranged, _ = write_scratch(df.withColumn("_w", weight.cast("long")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_s", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    totals = ranged.groupBy("_p").agg(F.sum("_w").alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(starts), "_p").withColumn(new, F.col("_s") + F.col("_b")).drop("_p", "_w", "_s", "_b")


def tagged(df: DataFrame, new: str, order: list[str], descending: bool, within: list[str], start: int) -> DataFrame:
    """Add consecutive numbers from start, per group if within is given, as long.

    The remaining attributes end the order, so the result is determined. Groups
    are numbered in one order of all tuples, less what stands before each: a
    group that holds most tuples is spread over many tasks like the others.
    """
    rest = [c for c in df.columns if c not in order and c not in within]
    keys = [quoted(c).desc() if descending else quoted(c).asc() for c in order] + [quoted(c).asc() for c in rest]
    if not within and not keys:
        return df.withColumn(new, F.lit(start).cast("long"))
    if not keys:  # all attributes form the group
        return df.withColumn(new, F.lit(start).cast("long"))
    numbered = number(df, [*map(quoted, within), *keys], "_tag")
    if not within:
        return numbered.withColumn("_tag", F.col("_tag") + start).withColumnRenamed("_tag", new)
    numbered, _ = write_scratch(numbered, "tagged")
    # Written, so that the join shuffles both sides and a large group can be split.
    first, _ = write_scratch(numbered.groupBy(*(quoted(c).alias(f"_g{i}") for i, c in enumerate(within))).agg(F.min("_tag").alias("_first")), "groups")
    same = [quoted(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(within)]
    both = numbered.join(first, reduce(Column.__and__, same))
    return both.select(*map(quoted, df.columns), (F.col("_tag") - F.col("_first") + start).alias(new))
