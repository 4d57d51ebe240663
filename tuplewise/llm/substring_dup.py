"""Operator 4: substring dedup by relative Lempel-Ziv parsing.

Reference blocks. Every window of 35 words has an anchor: the run of 8 words
in it with the least hash. Consecutive windows with one anchor make a block of
at most 28 windows; equal texts are cut into equal blocks wherever they stand.
The blocks of all documents are the reference, indexed by anchor with the
document and the place where they stand.

Lookup. An anchor that is found once starts no window found elsewhere. An
anchor whose blocks are all equal settles these blocks whole: its first and its
last occurrence in the index are where a match can start. Blocks with a known
anchor but another surrounding stand at a factor's boundary: their windows are
checked one by one, again with the first and last occurrence of each.

Parsing. From the left, each factor is the longest match that begins at the
next known window: it is followed through one of the two occurrences, block by
block and window by window, as long as that document goes on in the same way.
Factors are (start, end, source, source_start); none is shorter than a window,
and together they are the duplicate spans.

So some 7 percent of the windows are indexed as one row each, long repeats are
never compared word by word, and a passage that millions of documents share
costs each of them a row and none of them more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, carried, ddl, loose, materialise, mix, require, shingle_hashes, slices

ANCHOR = 8
_STEPS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: A place in the reference: the upper bits of a document's key, and the word (the lower bits).
_WORD = (1 << 24) - 1


class Parser:
    """Cuts the words of one text after another into reference blocks."""

    def __init__(self, window: int):
        if not ANCHOR <= window <= ANCHOR + 0xFFFE:
            raise ValueError(f"a window has {ANCHOR} to {ANCHOR + 0xFFFE} words")
        self.window, self.reach = window, window - ANCHOR + 1
        self.hashes = WordHashes()
        self.powers = [(np.ones(1, np.uint64),) * 2] * len(_STEPS)

    def sums(self, hashes: np.ndarray, which: int = 0) -> np.ndarray:
        """Prefix sums of one of two polynomials in the words' hashes."""
        if len(self.powers[which][0]) <= len(hashes):
            n, step = 2 * len(hashes) + 1, _STEPS[which]
            self.powers[which] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (step, pow(step, -1, 2**64)))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[which][0][: len(hashes)])])

    def content(self, sums: np.ndarray, start: np.ndarray, size: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the size words from each start, wherever they stand."""
        return mix((sums[start + size] - sums[start]) * self.powers[which][1][start] + size.astype(np.uint64)).view(np.int64)

    def blocks(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and anchor hash of each block."""
        if len(hashes) < self.window:
            none = np.empty(0, np.int64)
            return none, none, none
        grams = shingle_hashes(hashes, ANCHOR)
        windows = len(hashes) - self.window + 1
        at = np.empty(windows, np.int64)
        for low in range(0, windows, 4096):  # a long text in pieces
            part = grams[low : low + 4096 + self.reach - 1]
            at[low : low + 4096] = np.lib.stride_tricks.sliding_window_view(part, self.reach).argmin(axis=1) + np.arange(low, min(low + 4096, windows))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return first, np.diff(first, append=windows), grams[at[first]].view(np.int64)


def factors(known: list[tuple[int, int, int, int]], window: int, tag: int) -> list[tuple[int, int, int]]:
    """Greedy factors (start, end, source) of one text, in words.

    known: (first window, windows, first and last occurrence) of blocks and
    checked windows; tag: the text's own part of an occurrence, as a window is
    no match of itself.
    """
    known, out, i = sorted(known), [], 0
    while i < len(known):
        start, size, low, high = known[i]
        best = None
        for source in (low, high):
            if source == tag + (start & _WORD) and low != high:
                continue
            end, j = start + size, i + 1
            while j < len(known) and known[j][0] == end and source + end - start in known[j][2:]:
                end, j = end + known[j][1], j + 1
            if best is None or end > best[0]:
                best = end, j, source
        end, i, source = best
        out.append((start, end - 1 + window, source))
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of words that factors cover, from the left."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def drop_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Return (id_col, n_words, n_removed, spans, kept, tag, factors), a row per input row.

    Words are runs of anything but space and \\x09-\\x0D. A word goes if a
    window of consecutive words covers it whose sequence starts anywhere else
    in the table, in the same document too; every occurrence goes. spans is an
    array of (start, end) in words; kept is the other words, joined by one
    space. factors is an array of (start, end, source, source_start): the match
    goes on from that word of a document with this tag. Tags are 40 bits of a
    hash and may, rarely, be shared; source_start is given modulo 2^24. Null,
    empty and short texts lose nothing (kept is empty without
    words). Repeated rows are occurrences of each other, so their windows go;
    rows are told apart by two hashes of id and text, so null and equal ids
    are fine, and windows by 96 bits of hashes of their words. Very long texts
    are read whole. An empty table gives no rows. Other columns are not read, or with
    carry come along as they are, with the text; results replace columns of
    their names.
    """
    require(docs, id_col, text_col)
    added = ("n_words", "n_removed", "spans", "kept", "tag", "factors")
    more = carried(docs, carry, id_col, *added)
    key = docs.select(id_col).dtypes[0][1]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)))
    keyed = plain.select("*", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "id").alias("k2"))
    along = [f"c{i}" for i in range(len(more))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window)
        for batch in batches:
            for part in slices(batch):
                keys, found = [], []
                for i, t in enumerate(part.column(0).to_pylist()):
                    hashes = parser.hashes.of(t.encode("utf-8").split())
                    first, count, anchor = parser.blocks(hashes)
                    if len(first):
                        keys.append(np.full(len(first), i))
                        found.append((first << 16 | count, anchor, parser.content(parser.sums(hashes), first, count + window - 1)))
                if keys:
                    at = pa.array(np.concatenate(keys))
                    yield pa.RecordBatch.from_arrays([part.column(1).take(at), part.column(2).take(at), *(pa.array(np.concatenate(x)) for x in zip(*found))], names=["k1", "k2", "span", "anchor", "block"])

    blocks = materialise(keyed.select("text", "k1", "k2").mapInArrow(index, "k1 long, k2 long, span long, anchor long, block long"), "blocks")
    place = lambda start: F.col("k1").bitwiseAND(~_WORD).bitwiseOR(start.bitwiseAND(_WORD))
    found = place(F.shiftright("span", 16))
    known = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("block") != F.max("block")).alias("mixed"), F.min(found).alias("low"), F.max(found).alias("high")).filter("n > 1")
    hits = blocks.select("k1", "k2", "span", "anchor").join(loose(known.select("anchor", "mixed", "low", "high"), "anchor"), "anchor")
    hits = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.when(~F.col("mixed"), F.array("span", "low", "high")))).alias("known"), F.collect_list(F.when(F.col("mixed"), F.col("span"))).alias("open"))
    hits = materialise(hits, "hits")

    def boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window)
        for batch in batches:
            for part in slices(batch):
                keys, found = [], []
                for i, (t, spans) in enumerate(zip(part.column(1).to_pylist(), part.column(4).to_pylist())):
                    hashes = parser.hashes.of(t.encode("utf-8").split())
                    spans = np.unique(np.array(spans, np.int64))  # rows that repeat share their keys
                    count = spans & 0xFFFF
                    start = np.repeat((spans >> 16) - np.cumsum(count) + count, count) + np.arange(count.sum())
                    size = np.full(len(start), window)
                    one, two = (parser.content(parser.sums(hashes, k), start, size, k) for k in (0, 1))
                    keys.append(np.full(len(start), i))
                    found.append((start << 32 | two & 0xFFFFFFFF, one))
                if keys:
                    at = pa.array(np.concatenate(keys))
                    yield pa.RecordBatch.from_arrays([part.column(2).take(at), part.column(3).take(at), *(pa.array(np.concatenate(x)) for x in zip(*found))], names=["k1", "k2", "at", "content"])

    # All columns go along so that both joins read one shuffle of the texts.
    unsettled = keyed.join(hits.filter(F.size("open") > 0).select("k1", "k2", "open"), ["k1", "k2"]).select("id", "text", "k1", "k2", "open", *along)
    windows = unsettled.mapInArrow(boundary, "k1 long, k2 long, at long, content long")
    second, start = F.col("at").bitwiseAND(0xFFFFFFFF), F.shiftright("at", 32)
    twice = windows.groupBy("content", second.alias("second")).agg(F.count(F.lit(1)).alias("n"), F.min(place(start)).alias("low"), F.max(place(start)).alias("high")).filter("n > 1")
    twice = loose(twice, "content").select(F.col("content").alias("c1"), F.col("second").alias("c2"), "low", "high")
    singles = windows.join(twice, (F.col("content") == F.col("c1")) & (second == F.col("c2"))).groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.array(start, "low", "high"))).alias("singles"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = [[], [], [], [], [], []]
                for t, k1, blocks, single in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4))):
                    words, tag = t.encode("utf-8").split(), k1 & ~_WORD
                    known = {(s >> 16, s & 0xFFFF, a, b) for s, a, b in zip(*[iter(blocks or ())] * 3)} | {(s, 1, a, b) for s, a, b in zip(*[iter(single or ())] * 3)}
                    parsed = factors(list(known), window, tag)
                    kept, at, gone = [], 0, merged(parsed)
                    for start, end in gone:
                        kept += words[at:start]
                        at = end
                    kept += words[at:]
                    parsed = [{"start": a, "end": b, "source": x >> 24, "source_start": x & _WORD} for a, b, x in parsed]
                    for column, value in zip(rows, (len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in gone], b" ".join(kept).decode(), tag >> 24, parsed)):
                        column.append(value)
                long = pa.int64()
                span, factor = (pa.list_(pa.struct([(n, long) for n in names])) for names in (("start", "end"), ("start", "end", "source", "source_start")))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, rows, (long, long, span, pa.string(), long, factor)), *part.columns[5:]], names=[id_col, *added, *more])

    ready = keyed.join(hits.select("k1", "k2", "known"), ["k1", "k2"], "left").join(singles, ["k1", "k2"], "left").select("id", "text", "k1", "known", "singles", *along)
    return ready.mapInArrow(remove, f"`{id_col}` {key}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string, tag long, factors array<struct<start:long,end:long,source:long,source_start:long>>" + ddl(docs, more))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of all documents without repeated passages, as counts and a digest."""
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
