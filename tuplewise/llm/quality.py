"""Operator 5: quality rules with adaptive thresholds from mergeable quantile sketches.

Every text gives counts, the sizes they belong to, and four shares (in
millionths). A sketch of each share and size per language and source is a
histogram over buckets whose width grows with the value (at most 1/16 of it):
integers only, so sketches merge by adding counts, in any order, to the same
result. Quantiles of a group's texts that pass the base rules give its
thresholds, and nothing else does: no threshold has a fixed part. Small groups
use the merged sketch of their language, then of all rows. Documents then join
their group's thresholds. Everything is native DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, materialise, require

#: Shares that have thresholds: the count, the size it is a share of, how much of it is one
#: occurrence (two windows of five words for a repeat), and the percentile that shows the spread.
#: Junk that fills a tenth of a group moves the 95th percentile of its shares, so symbols use a lower one.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1, 75),
    "dup_lines": ("n_dup_lines", "n_lines", 1, 95),
    "repeat_words": ("n_repeat_words", "n_words", 10, 95),
    "capitals": ("n_capitals", "word_chars", 1, 95),
}
SIZES = ("word_chars", "n_lines", "n_words")
#: How far above the median a share may lie: in spreads, and in occurrences.
SPREAD, EXTRA = 6, 2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Thresholds of at most this many groups are broadcast (under 10 MB); more are joined by a shuffle.
BROADCAST_GROUPS = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body has lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column, n: Column, width: int) -> Column:
    """Words in windows of this width that the text has twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def twins(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        found = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, twins)).otherwise(F.lit(0))

    return F.when(n >= width, let(hashes, count)).otherwise(F.lit(0))


def text_counts(text: Column, width: int = 5) -> Column:
    """Struct of COUNTS, n_lines and n_capitals (all long) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(F.size(w), lambda n: _repeated(w, n, width)).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = let(F.filter(F.split(text, WORD_GAP), lambda w: w != ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), of_lines)
    marks = F.struct(without(r"[#*$%&|<>]").cast("long").alias("n_symbols"), without("[A-Z]").cast("long").alias("n_capitals"))
    return F.struct(words.alias("w"), lines.alias("l"), marks.alias("m"))


def bucket(value: Column) -> Column:
    """Sketch bucket of a value: itself under 32, then 16 buckets for each power of two."""
    k = F.length(F.bin(value)) - 5
    return F.when(value < 32, value).otherwise(k * 16 + F.floor(value / F.pow(F.lit(2), k))).cast("int")


def bucket_top(b: Column) -> Column:
    """Largest value that falls into bucket b."""
    k = F.floor((b - 16) / 16)
    return F.when(b < 32, b).otherwise(((b - 16 * k) + 1) * F.pow(F.lit(2), k) - 1).cast("long")


def thresholds(shares: DataFrame, *, spread: int = SPREAD, least_rows: int = 50) -> DataFrame:
    """Per (lang, source) an upper threshold of each metric, named t_<metric>.

    shares has lang, source, the METRICS and the SIZES columns. A threshold is
    median + spread * (upper percentile - median) + EXTRA * one, in millionths,
    where one is the share that one occurrence has in a text of the group's
    median size: it counts where most shares are zero. Groups of
    fewer than least_rows rows take the thresholds of their language, and those
    of all rows if the language too has fewer.
    """
    names = [*METRICS, *SIZES]
    long = shares.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in names))).alias("x"))
    sketch = long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    level_of = lambda k, a, b: F.struct(F.lit(k).alias("level"), a.alias("a"), b.alias("b"))
    levels = sketch.select(F.explode(F.array(level_of(0, F.col("lang"), F.col("source")), level_of(1, F.col("lang"), none), level_of(2, none, none))).alias("g"), "metric", "bucket", "n")
    merged = levels.groupBy("g", "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("g", "metric")
    ranked = merged.select("*", F.sum("n").over(group).alias("rows"), F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    at = lambda percent: bucket_top(F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, F.col("bucket"))))
    high = F.coalesce(*(F.when(F.col("metric") == m, F.lit(x[3])) for m, x in METRICS.items()), F.lit(50))
    limit = ranked.groupBy("g", "metric").agg(F.first("rows").alias("rows"), at(50).alias("mid"), at(high).alias("high"))
    of = lambda value, m: F.max(F.when(F.col("metric") == m, F.col(value)))

    def threshold(m: str) -> Column:
        _, size, unit, _ = METRICS[m]
        return of("mid", m) + spread * (of("high", m) - of("mid", m)) + EXTRA * F.floor(F.lit(unit * 1_000_000) / F.greatest(of("mid", size), F.lit(1)))

    wide = limit.groupBy("g").agg(F.first("rows").alias("rows"), *(threshold(m).alias(f"t_{m}") for m in METRICS))
    names = [f"t_{m}" for m in METRICS]

    def level(k: int, *keys: str) -> DataFrame:
        return wide.filter(F.col("g.level") == k).select(F.lit(0).alias(f"every{k}"), *(F.col(f"g.{x}").alias(f"{x}{k}") for x in keys), F.col("rows").alias(f"rows{k}"), *(F.col(n).alias(f"{n}{k}") for n in names))

    own, lang, every = level(0, "a", "b"), level(1, "a"), level(2)
    both = own.join(lang, F.col("a0").eqNullSafe(F.col("a1"))).join(F.broadcast(every), F.col("every0") == F.col("every2"))  # one row
    chosen = lambda n: F.when(F.col("rows0") >= least_rows, F.col(f"{n}0")).when(F.col("rows1") >= least_rows, F.col(f"{n}1")).otherwise(F.col(f"{n}2"))
    return both.select(F.col("a0").alias("t_lang"), F.col("b0").alias("t_source"), *(chosen(n).alias(n) for n in names))


def assess_quality(docs: DataFrame, *, min_words: int = 10, max_repeat_percent: int = 20, spread: int = SPREAD, least_rows: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Add COUNTS, base_failed and kept to docs; other columns of these names are replaced.

    base_failed: fewer than min_words words, or more than max_repeat_percent
    of them in repeated 5-word windows. kept: not base_failed, and no share,
    less one occurrence, above its group's threshold, which comes from the
    group's texts that pass the base. A null text counts as empty and fails;
    null languages and sources are groups like others; very long texts are
    read whole; repeated rows all count; an empty table gives no rows. One pass computes the counts and writes them
    with the rows to the shared folder; sketches shuffle as partial counts,
    so a source that holds most rows costs no more than another.
    """
    require(docs, text_col, lang_col, source_col)
    added = {*COUNTS, "base_failed", "kept"}
    keep = [c for c in docs.columns if c not in added]
    names = [f"c{i}" for i in range(len(keep))]  # no clash with what is added
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)))
    of = lambda c: names[keep.index(c)]
    step = plain.select("*", text_counts(F.col(of(text_col)).cast("string")).alias("x"))
    counted = step.select(*names, *(F.col(f"x.{p}.{c}") for p, c in (("w", "n_words"), ("w", "word_chars"), ("m", "n_symbols"), ("l", "n_dup_lines"), ("w", "n_repeat_words"), ("l", "n_lines"), ("m", "n_capitals"))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    share = lambda part, whole, less: F.expr(f"greatest({part} - {less}, 0) * 1000000 div greatest({whole}, 1)")
    counted = materialise(counted, "quality")
    full = counted.select("*", F.col(of(lang_col)).cast("string").alias("lang"), F.col(of(source_col)).cast("string").alias("source"), failed.alias("base_failed"))
    passed = full.filter("not base_failed").select("lang", "source", *(share(a, b, 0).alias(m) for m, (a, b, _, _) in METRICS.items()), *SIZES)
    limits = materialise(thresholds(passed, spread=spread, least_rows=least_rows), "thresholds")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = full.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    within = F.lit(True)
    for m, (a, b, one, _) in METRICS.items():
        within &= share(a, b, one) <= F.col(f"t_{m}")
    return joined.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counted = assess_quality(docs.select("doc_id", "text", "lang", "source"))
    return counted.select("doc_id", *COUNTS, "base_failed", "kept")
