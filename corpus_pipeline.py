"""A corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes what its predecessor kept, as a written table; all but the
last return the columns of documents. Nulls in any column, empty and very long
texts, ties, repeated rows, empty tables and extra columns pass through every
stage; each stage's docstring says what becomes of them.

A stage's scratch tables go when a later stage on the same folder starts, as
that one reads the written result; run() deletes them itself. Scratch tables of
operators used outside the pipeline are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.llm.common import Scope, materialise
from tuplewise.llm.near_dup import near_duplicates
from tuplewise.llm.packing import pack_documents
from tuplewise.llm.quality import assess_quality
from tuplewise.llm.secrets import find_secrets
from tuplewise.llm.substring_dup import drop_repeats

#: Per folder, the scopes of the stages that ran on it, by place in STAGES.
_chains: dict[str, dict[int, Scope]] = {}


def _stage(place: int):
    """Give a stage a scope of its own; scopes of the stages before it are released."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            chain = _chains.setdefault(sf_dir, {})
            for k in sorted(k for k in chain if k < place):
                chain.pop(k).release(spark)
            with Scope() as scope:
                out = f(spark, docs, sf_dir)
            chain[place] = scope
            return out

        return stage

    return wrap


@_stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts fail and go. Null languages and sources are
    groups like others; repeated rows are judged alike; very long texts are
    read whole; an empty table stays empty; all columns come along.
    """
    return assess_quality(docs).filter("kept").select(*docs.columns)


@_stage(1)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at 80 percent of five-word shingles.

    Rows are documents of their own, also those with the same or a null id;
    the row with the smallest id stays (null is the last). Texts that are null
    or without words are linked with nothing and stay; very long texts are read
    whole; an empty table stays empty; all columns come along.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    # Written, so that a row has the same key in each pass.
    rows = materialise(docs.select(F.monotonically_increasing_id().alias(row), "*"), "rows")
    placed = near_duplicates(rows, percent=80, id_col=row).select(F.col(row).alias("row"), F.col("component_id").alias("component"))
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    first = placed.join(ids, "row").groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


@_stage(2)
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words and more that occur twice.

    A text that loses words becomes the others, joined by spaces; one that
    loses all stays as an empty text. Null, empty and short texts stay as they
    are; repeated rows are occurrences of each other, so their windows go; an
    empty table stays empty; all columns come along.
    """
    cut = drop_repeats(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return _with_text(cut, text, docs.columns)


@_stage(3)
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by the name of its kind.

    Null and empty texts stay as they are; very long texts are read whole;
    repeated rows are masked alike; an empty table stays empty; all columns
    come along.
    """
    found = find_secrets(docs, masked=True, carry=True)
    return _with_text(found, F.col("masked"), docs.columns)


@_stage(4)
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of at most 2048 ids.

    Null and empty texts are the end id alone; very long texts are cut;
    repeated rows are packed each; an empty table gives no pieces; of the other
    columns only doc_id is kept.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), markers=True)


def _with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Tokenising and MinHash have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Scope() as work:
            made = stage.__wrapped__(spark, docs, sf_dir)
        with Scope() as result:
            docs = materialise(made, name)
        work.release(spark)
        if before is not None:
            before.release(spark)
        before = result
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
