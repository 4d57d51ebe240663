"""Shared helpers: scratch tables, word splitting and hashing, column guards."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from contextvars import ContextVar
from typing import ClassVar

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master whose session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/tuplewise"

#: Words are maximal runs of anything but space and \x09-\x0D; bytes.split()
#: without arguments splits at exactly these six bytes.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    RuntimeError where it is unset and the master isn't local: a folder of one
    machine would hide each executor's files from the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = FALLBACK_DIR
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scope:
    """The tables that materialise() writes while it is entered; scopes nest.

    release() deletes them, so call it once what reads them is written. Tables
    of no scope, and of scopes that nobody releases, go when Python ends.
    """

    _open: ContextVar[tuple[Scope, ...]] = ContextVar("open scopes", default=())
    _all: ClassVar[list[Scope]] = []

    def __init__(self):
        self.paths: list[str] = []
        if not Scope._all:
            atexit.register(_at_exit)
        Scope._all.append(self)

    def __enter__(self) -> Scope:
        Scope._open.set((*Scope._open.get(), self))
        return self

    def __exit__(self, *_) -> None:
        Scope._open.set(Scope._open.get()[:-1])

    def release(self, spark: SparkSession) -> None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = hadoop(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)
        if self in Scope._all:
            Scope._all.remove(self)

    @classmethod
    def current(cls) -> Scope:
        return cls._open.get()[-1] if cls._open.get() else _process


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor re-reads files instead of recomputing. The
    table lives as long as the scope that is entered now.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    Scope.current().paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def loose(df: DataFrame, key: str) -> DataFrame:
    """df with its partitioning by an integer key forgotten.

    An aggregate by the key is dealt by it already; a join would then shuffle
    the other side alone, and adaptive execution can't split a hot key.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            for scope in [*Scope._all]:
                scope.release(spark)


_process = Scope()


class WordHashes(dict):
    """Bytes of a word -> 64-bit hash; remembers a bounded number of words."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Memo(dict):
    """Remembers make(key) for short keys in two generations of bounded size.

    When the young one is full it becomes the old one; what is still used
    moves over, so frequent keys stay.
    """

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > self.longest:
                return out
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit of a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; empty if there are fewer."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        out *= step
        out += words[i : i + size]
    return mix(out)


def slices(batch, rows: int = 256):
    """Small pieces of an Arrow batch, so that few texts are Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def carried(docs: DataFrame, carry: bool, *used: str) -> list[str]:
    """Columns that go along unchanged: all but those used, if carry."""
    return [c for c in docs.columns if carry and c not in used]


def ddl(df: DataFrame, names: list[str]) -> str:
    return "".join(f", `{n}` {df.select(f'`{n}`').schema[0].dataType.simpleString()}" for n in names)
