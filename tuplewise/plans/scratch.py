"""Tables in the folder that driver and executors share, to cut lineage.

Every table is known here and goes when Python ends, or sooner with delete().
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master whose session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/tuplewise"

_live: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset is an error unless the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = FALLBACK_DIR
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_scratch(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written and read back, and its path."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    if not _live:
        atexit.register(delete_all)
    _live.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _live.discard(path)


def delete_all() -> None:
    """Delete every table; the JVM may be gone already."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):
            for path in sorted(_live):
                delete(spark, path)
