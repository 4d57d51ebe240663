"""Transitive closure by semi-naive iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import write_scratch


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All pairs (u, v) with a path from u to v; edges has columns u and v.

    Round i joins the pairs that round i - 1 was the first to find with all
    pairs found so far, so path lengths double and a chain of n edges takes
    about log n rounds; cycles end when nothing is new. Each round's new pairs
    are written once, to the shared folder, and what was found so far is read
    as those tables together: nothing is rewritten, a lost executor costs a
    re-read, and a small round is broadcast by Spark's own size check.
    """
    spark = edges.sparkSession
    delta, path = write_scratch(edges.distinct(), "closure")
    paths, count = [path], delta.count()
    while count:
        full = spark.read.schema(edges.schema).parquet(*paths)
        step = _compose(delta, full).unionByName(_compose(full, delta)).distinct()
        delta, path = write_scratch(step.join(full, ["u", "v"], "left_anti"), "closure")
        paths.append(path)
        count = delta.count()
    return spark.read.schema(edges.schema).parquet(*paths)


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("u", F.col("v").alias("w"))
    return left.join(b.select(F.col("u").alias("w"), "v"), "w").select("u", "v")
