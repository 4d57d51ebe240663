"""The driver's tables as relations, with the keys that hold in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..relation import Relation

KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "supplier": ["s_suppkey"],
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
}
#: Tables of distinct rows without a smaller key.
SETS = ("lineitem",)


def table(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Relation(df, is_set=name in SETS, keys=[KEYS[name]] if name in KEYS else ())
