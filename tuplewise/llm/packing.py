"""Operator 1: best-fit packing by exact-complement hashing.

Lengths are at most the capacity, so the corpus is a histogram of bounded
size whatever its number of documents. The plan is made on that histogram: for
each length, longest first, the gap that it leaves is filled exactly by one,
two or three lengths still available; what no combination fills goes best-fit.
The index of sums is one of bit sets: bit n of the first tells that length n is
left, bit n of the second that two lengths left add up to n. Shifted and
reflected, one has a bit for each first part of a pair that fills a gap, the
other for each first part of a triple. Each step uses a class of
lengths up, or a class of open sequences, so the plan too is of bounded size.
Pieces find their place by their rank within their length: a count per input
partition, a running sum of these counts, and a search in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import cut
from .common import Memo, materialise, require, slices


class Pattern:
    """count sequences that each hold pieces of these lengths, in this order."""

    __slots__ = ("count", "lengths")

    def __init__(self, lengths: list[int], count: int):
        self.lengths, self.count = lengths, count


def plan_packing(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use every piece of the histogram {length: count} once."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    if any(n < 0 or n > capacity for n in left):
        raise ValueError("a piece is longer than the capacity")
    plan: list[Pattern] = []
    if left.get(0):
        plan.append(Pattern([0] * 1, left.pop(0)))
    have = mirror = 0  # bit n: length n is left; mirror: bit capacity - n
    sums = 0  # mirror of the sums of two lengths; lengths used up since then only make it larger than it need be
    stale = 1 << 30

    def mark(n: int, on: bool) -> None:
        nonlocal have, mirror, stale
        stale += 1
        a, b = 1 << n, 1 << (capacity - n)
        have, mirror = (have | a, mirror | b) if on else (have & ~a, mirror & ~b)

    for n in left:
        mark(n, True)

    def pair_sums() -> None:
        nonlocal sums, stale
        if stale > 32:
            stale, sums = 0, 0
            for a in range(1, capacity):
                if have >> a & 1:
                    sums |= mirror >> a  # bit capacity - (a + b)

    def two(gap: int, first: Counter, at_most: int) -> list[int] | None:
        """Two lengths that sum to gap, the longer as long as can be."""
        both = have & (mirror >> (capacity - gap)) & ((1 << (at_most + 1)) - 1)
        while both:
            a = both.bit_length() - 1
            b = gap - a
            if b <= 0 or b > a:
                both &= ~(1 << a)
                if b > a:
                    return None
                continue
            need = first + Counter((a, b))
            if all(left[x] >= k for x, k in need.items()):
                return [a, b]
            both &= ~(1 << a)
        return None

    def complement(n: int) -> list[int] | None:
        """One to three lengths that fill the gap beside n exactly."""
        gap, first = capacity - n, Counter((n,))
        if gap == 0:
            return []
        if left[gap] >= 1 + (gap == n):
            return [gap]
        if (found := two(gap, first, gap)) is not None:
            return found
        pair_sums()
        some = have & (sums >> (capacity - gap)) & ((1 << gap) - 1)
        while some:
            a = some.bit_length() - 1
            some &= ~(1 << a)
            if 3 * a < gap:
                return None
            if left[a] >= 1 + (a == n) and (found := two(gap - a, first + Counter((a,)), min(a, gap - a))) is not None:
                return [a, *found]
        return None

    for n in range(capacity, 0, -1):
        while left[n]:
            rest = complement(n)
            if rest is None:
                break
            need = Counter([n, *rest])
            times = min(left[x] // k for x, k in need.items())
            plan.append(Pattern([n, *rest], times))
            for x, k in need.items():
                left[x] -= k * times
                if not left[x]:
                    mark(x, False)

    # Best fit: the longest piece goes to the open sequence with the smallest gap that holds it.
    open_: dict[int, list[Pattern]] = {}
    gaps = 0
    for n in range(capacity, 0, -1):
        while left[n]:
            fits = gaps >> n
            if fits:
                gap = n + (fits & -fits).bit_length() - 1
                old = open_[gap].pop()
                if not open_[gap]:
                    gaps &= ~(1 << gap)
                times = min(old.count, left[n])
                if old.count > times:
                    open_[gap].append(Pattern(old.lengths, old.count - times))
                    gaps |= 1 << gap
                new = Pattern([*old.lengths, n], times)
                left[n] -= times
                gap -= n
            else:
                each = min(capacity // n, left[n])
                times = left[n] // each
                new = Pattern([n] * each, times)
                left[n] -= times * each
                gap = capacity - each * n
            if gap:
                open_.setdefault(gap, []).append(new)
                gaps |= 1 << gap
            else:
                plan.append(new)
    return plan + [p for group in open_.values() for p in group]


def places(plan: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank.

    The i-th piece of a length, from the row's first rank on, lies in sequence
    first sequence + i at this offset.
    """
    rows, used, base = [], Counter(), 0
    for p in plan:
        offset = 0
        for n in p.lengths:
            rows.append((n, used[n], base, offset))
            used[n] += p.count
            offset += n
        base += p.count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


@lru_cache(maxsize=2)
def _markers(path: str) -> tuple[re.Pattern, dict[str, bytes]]:
    """What finds the added tokens of a tokenizer file, the longest first, and their ids."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("this file's added tokens are not plain strings")
    ids = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")" if ids else "(?!)()"), ids


@lru_cache(maxsize=2)
def _ids(path: str) -> Memo:
    """Piece of text after a space -> its ids, by a tokenizer file.

    The file's merges stand in the order of their ids, so merging by lowest id
    gives what its own library gives; this is checked here.
    """
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*visible}))}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if all(c in byte for c in t) and not t.startswith("<|")}
    merged = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if merged != sorted(merged) or len({*merged}) != len(merged):
        raise ValueError("this file's merges are not in the order of its ids")
    core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    memo = Memo(lambda p: array("I", core.encode_ordinary("\x20" + p)).tobytes(), 300_000)
    memo.first = lambda p: array("I", core.encode_ordinary(p)).tobytes()
    return memo


def split_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole capacities, the rest first."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True, markers: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut documents into pieces and lay these in sequences of at most capacity ids.

    Returns per piece (id_col, piece, start, length, ids_crc32, sequence_id,
    offset) and, with keep_ids, ids (little-endian unsigned 32-bit). A document
    is its text's ids by the tokenizer file at path, then end_id; nothing is put
    around it. With markers, the strings of the file's added tokens have their
    ids, as the tokenizers library does by default; else they are ordinary text. Null and empty texts are
    end_id alone; very long ones are cut. Repeated rows and equal or null ids of documents are packed
    like any other rows; an empty table gives no pieces; other columns are not
    read. Runs one pass over the texts; its pieces are written to the shared
    folder, then ranked within their length by partial counts: no task sees
    all pieces of a length, and only the histogram (capacity rows) and the
    plan (bounded by the capacity) meet in the driver.
    """
    require(docs, id_col, text_col)
    key = docs.select(id_col).dtypes[0][1]
    names = [id_col, "piece", "start", "length", "ids_crc32", "ids", "at", "nth"]
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, at = _ids(path), Counter(), TaskContext.get().partitionId()
        marker, marked = _markers(path) if markers else (None, {})

        def plain(text: str) -> bytes:
            words = cut(text)
            return memo.first(words[0]) + b"".join(map(memo.__getitem__, words[1:]))

        def encode(text: str) -> bytes:
            if not any(m in text for m in marked):
                return plain(text)
            parts = marker.split(text)  # every other one is a marker
            return b"".join(marked[p] if i % 2 else plain(p) for i, p in enumerate(parts))

        for batch in batches:
            for part in slices(batch):
                row: list[list] = [[] for _ in names[1:]]
                of = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    start = 0
                    for k, n in enumerate(split_lengths(len(ids) // 4, capacity)):
                        mine = ids[4 * start : 4 * (start + n)]
                        of.append(i)
                        for column, value in zip(row, (k, start, n, zlib.crc32(mine), mine if keep_ids else None, at, seen[n]), strict=True):
                            column.append(value)
                        seen[n] += 1
                        start += n
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *map(pa.array, row, kinds)], names=names)

    cut_up = materialise(
        docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(pieces, f"`{id_col}` {key}, piece int, start long, length long, ids_crc32 long, ids binary, at long, nth long"),
        "pieces",
    )
    counts = cut_up.groupBy("length", "at").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(plan_packing(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            mine = rows[np.searchsorted(keys, n << 48 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(mine[:, 2] + rank - mine[:, 1]), pa.array(mine[:, 3])], names=[*names[:6], "sequence_id", "offset"])

    ranked = cut_up.join(before, ["length", "at"]).select(*names[:6], (F.col("before") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(place, f"`{id_col}` {key}, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    return out if keep_ids else out.drop("ids")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False, markers=True)
