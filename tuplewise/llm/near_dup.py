"""Operator 10: MinHash near-duplicates.

Texts become sets of word shingles; equal sets collapse into one class before
anything else, so exact copies cost one row each. Universal-hash minima form a
signature; bands of it give buckets. In each bucket the smallest class is
compared with the others, which links most of a group of near copies without
its pairs. Components of these links are found by alternating large-star and
small-star. Then each document's likeliest partner in another component is
tried, and what still lies in different components of one bucket is compared
in tiles: by signature, and on the full sets where that leaves it open. So no
link is lost, every link is confirmed on full sets, and nothing is written for
a pair that isn't one: tables grow with documents and their buckets, not with
the square of a group. Only the comparing inside a tile does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, loose, materialise, mix, require, shingle_hashes, slices

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Rows of a bucket's tile; larger buckets are dealt over pairs of tiles.
TILE = 384
_random = np.random.default_rng(20_11)
_TIMES = _random.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
_PLUS = _random.integers(0, 2**32, HASHES, np.uint32)


def shingle_set(text: str, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z lower-cased."""
    hashes = words.of(text.encode("utf-8").lower().split())
    return np.unique(shingle_hashes(hashes, min(width, len(hashes)))) if len(hashes) else hashes


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES universal-hash minima of each non-empty set, as uint32."""
    out = np.empty((HASHES, len(sets)), np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    y = np.empty_like(x)
    for i in range(HASHES):
        np.multiply(x, _TIMES[i], out=y)
        np.add(y, _PLUS[i], out=y)
        np.minimum.reduceat(y, starts, out=out[i])
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    rows = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for i in range(ROWS):
        keys = mix(keys + rows[:, :, i] + np.uint64(i))
    return keys


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, digest, bands, sig) per row; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in slices(batch, 128):
                sets = [shingle_set(t, width, words) if t else np.empty(0, np.uint64) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                found: list = [iter(())] * 3
                if full:
                    sig = minima(full)
                    found = [iter([xxhash.xxh3_128_digest(s.tobytes()) for s in full]), iter([k.tobytes() for k in band_keys(sig)]), iter([s.tobytes() for s in (sig >> np.uint32(24)).astype(np.uint8)])]
                columns = [pa.array([next(f) if len(s) else None for s in sets], pa.binary()) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *columns], names=["id", "n", "digest", "bands", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, digest binary, bands binary, sig binary")


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, id) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                if part.num_rows:
                    keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "id"])

    return classes.select("id", "bands").mapInArrow(run, "key long, id long")


def least_estimate(percent: int, miss: float) -> float:
    """The estimate below which a pair at percent falls with a probability of at most miss.

    One-byte minima agree independently, by chance once in 256 if not alike.
    """
    p = percent / 100 + (1 - percent / 100) / 256
    agree, below = 0, 0.0
    while agree <= HASHES and (below := below + comb(HASHES, agree) * p**agree * (1 - p) ** (HASHES - agree)) <= miss:
        agree += 1
    return ((agree - 0.5) / HASHES - 1 / 256) / (255 / 256)  # half a count lower, against rounding


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of a with each of b, from one byte a hash."""
    equal = np.empty((len(a), len(b)), np.float32)
    for i in range(len(a)):
        equal[i] = (b == a[i]).sum(axis=1)
    return (equal / HASHES - 1 / 256) / (255 / 256)


def _likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree enough for the similarity to be possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
                good = ((a == b).mean(axis=1) - 1 / 256) / (255 / 256) >= least
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        last, known = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, 128):
                good = []
                for a, ta, tb in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if a != last:
                        last, known = a, shingle_set(ta, width, words)
                    other = shingle_set(tb, width, words)
                    common = len(np.intersect1d(known, other, assume_unique=True))
                    good.append(100 * common >= percent * (len(known) + len(other) - common))
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, *values: str) -> DataFrame:
    """Rows (key, id, members, ...) of buckets, once for each pair of tiles (key, i, j) that they belong to.

    Tiles hold about TILE rows, by a hash of the id.
    """
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    dealt = rows.select("key", "id", *values, tiles.alias("tiles"), own.alias("own"))
    dealt = dealt.select("key", "id", *values, "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", *values)


def _by_tile(dealt: DataFrame, compare: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """compare(rows of one pair of tiles); each task goes through its sorted pairs one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in (0, 1, 2)):
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from compare(pa.Table.from_batches(held))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the rows of both tiles, and whether they are one tile."""
    own = t.column("own").to_numpy()
    if t.column("i")[0].as_py() == t.column("j")[0].as_py():
        return np.arange(len(own)), np.arange(len(own)), True
    return np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min()), False


def _fixed(t: pa.Table, name: str, kind: type, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(-1, size)


def _best_partners(rows: DataFrame, least: float) -> DataFrame:
    """Each row's likeliest partner of another component in each tile of its buckets.

    rows: key, id, component, sig, members (of the bucket).
    """

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, comp = (t.column(c).to_numpy() for c in ("id", "component"))
        sig, (left, right, _) = _fixed(t, "sig", np.uint8, HASHES), _sides(t)
        for at in range(0, len(left), 128):
            block = left[at : at + 128]
            good = comp[block][:, None] != comp[right][None, :]
            some = np.flatnonzero(good.any(axis=1))
            if len(some):
                likely = np.where(good[some], _agreement(sig[block[some]], sig[right]), -1)
                y = likely.argmax(axis=1)
                x = np.flatnonzero(likely[np.arange(len(y)), y] >= least)
                a, b = ids[block[some[x]]], ids[right[y[x]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _by_tile(_dealt(rows, "component", "sig"), compare, "a long, b long")


def _open_pairs(t: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of two tiles that lie in different components, are likely enough, and share no earlier band."""
    ids, comp, key = t.column("id").to_numpy(), t.column("component").to_numpy(), t.column("key")[0].as_py()
    sig, bands, (left, right, same) = _fixed(t, "sig", np.uint8, HASHES), _fixed(t, "bands", np.int64, BANDS), _sides(t)
    band = int((bands[0] == key).argmax())
    for at in range(0, len(left), 128):
        block = left[at : at + 128]
        good = (comp[block][:, None] != comp[right][None, :]) & ((ids[block][:, None] < ids[right][None, :]) | (not same))
        some = np.flatnonzero(good.any(axis=1))
        if len(some):
            x, y = np.nonzero(np.where(good[some], _agreement(sig[block[some]], sig[right]), -1) >= least)
            x, y = block[some[x]], right[y]
            first = ~(bands[x, :band] == bands[y, :band]).any(axis=1)
            if first.any():
                yield x[first], y[first]


def _open_rows(rows: DataFrame, least: float) -> DataFrame:
    """(key, i, j, own, id, component, bands, sig) of rows that have such a pair: at most as many as there are."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(t.num_rows, bool)
        for x, y in _open_pairs(t, least):
            wanted[x] = wanted[y] = True
        if wanted.any():
            yield from t.filter(pa.array(wanted)).combine_chunks().to_batches()

    return _by_tile(_dealt(rows, "component", "bands", "sig"), compare, "key long, i int, j int, own int, id long, component long, bands binary, sig binary")


def _links(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) between components, confirmed on full sets: enough of them to join what is linked in a tile.

    rows: those of _open_rows, with their sets. Pairs that a link of this tile
    has joined already are skipped, so there are fewer links than rows.
    """

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy().copy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        size = np.array([len(x) for x in sets])
        for xs, ys in _open_pairs(t, least):
            for x in np.unique(xs):
                y = ys[xs == x]
                y = y[comp[y] != comp[x]]
                if not len(y):
                    continue
                at = np.cumsum(size[y]) - size[y]
                words = np.concatenate([sets[k] for k in y])
                hit = sets[x][np.minimum(np.searchsorted(sets[x], words), size[x] - 1)] == words
                common = np.add.reduceat(hit.astype(np.int64), at)
                for k in y[100 * common >= percent * (size[x] + size[y] - common)]:
                    if comp[k] != comp[x]:
                        yield pa.RecordBatch.from_arrays([pa.array([min(ids[x], ids[k])]), pa.array([max(ids[x], ids[k])])], names=["a", "b"])
                        comp[comp == comp[k]] = comp[x]

    return _by_tile(rows.select("key", "i", "j", "own", "id", "component", "bands", "sig", "set"), compare, "a long, b long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, set) of texts: the sorted hashes of a text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in slices(batch, 128):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, width, words).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def _joined(now: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links."""
    ends = links.join(now.toDF("a", "ca"), "a", "left").join(now.toDF("b", "cb"), "b", "left")
    more = materialise(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "merged")
    moved = now.join(more.toDF("component", "top"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return materialise(moved.unionByName(more.join(now, "id", "left_anti")), "components")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b); component is its smallest node.

    Large-star links each node's larger neighbours to its smallest neighbour,
    small-star the smaller ones and itself; this alternates until no edge
    changes. Each round is written to the shared folder. Self-loops vanish.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(u != v).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(u, F.min("v")).alias("m"))
        large = both.filter(v > u).join(loose(least, "u"), "u").select(v.alias("u"), m.alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(loose(least, "u"), "u").filter(v != m).select(v.alias("u"), m.alias("v"))
        now = materialise(small.unionByName(least.select("u", m.alias("v"))).distinct(), "stars")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
    leaf = now.select(u.alias("id"), v.alias("component"))
    return leaf.unionByName(now.select(v.alias("id"), v.alias("component")).distinct())


def near_duplicates(docs: DataFrame, *, percent: int = 80, width: int = 5, miss: float = 1e-7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id_col, n_shingles, component_id, kept), a row per input row.

    Two texts are linked if 100 * intersection >= percent * union of their
    sets of width-word shingles (fewer words: the whole sequence is one).
    component_id is the smallest id reachable by links, kept marks that
    document. Texts that are null, empty or without words are linked with
    nothing. Ids are integers; rows with a null id are linked with nothing and
    kept. Rows that repeat an id are one document, whose text is the least of
    theirs; all come back. Ties and equal texts are linked; very long texts are
    read whole; an empty table gives no rows; other columns are not read. A
    pair at 80 percent meets in no bucket with a probability of 1.3e-7; miss is
    the largest probability with which the signatures of a pair exactly at
    percent may agree too little for it to be confirmed.
    """
    require(docs, id_col, text_col)
    least = least_estimate(percent, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = materialise(_signatures(texts, "id", "text", width), "signatures")
    again = materialise(texts.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeated")
    texts, known, unique = texts.filter("id is not null and text is not null"), sigs, again.isEmpty()
    if not unique:
        chosen = materialise(texts.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "chosen")
        texts = texts.join(again, "id", "left_anti").unionByName(chosen)
        known = materialise(sigs.join(again, "id", "left_anti").unionByName(_signatures(chosen, "id", "text", width)), "known")
    known = known.filter("digest is not null and id is not null")
    # Written, so that joins by digest shuffle both sides and a hot one can be split.
    classes = materialise(known.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = materialise(known.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"]).select("id", "bands", "sig"), "reps")

    rows = _bucket_rows(reps)
    buckets = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialise(rows.join(loose(buckets, "key"), "key"), "buckets")
    texts = materialise(texts.join(shared.select("id").distinct(), "id", "left_semi"), "candidates")

    pairs = shared.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    now = materialise(components(_confirmed(_likely(pairs, reps, least), texts, percent, width)), "components")
    def apart(*values: str) -> DataFrame:
        """Rows of buckets that still hold several components."""
        placed = shared.join(now, "id", "left").select("key", "id", "members", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        return placed.join(loose(mixed, "key"), "key", "left_semi").join(reps.select("id", *values), "id")

    # First each document's likeliest partner elsewhere, which joins most of a
    # group's pieces in linear work; then all pairs that still lie apart, each
    # in the first band that they share, on full sets.
    partners = _best_partners(apart("sig"), percent / 100 - (percent / 100 - least) / 4).distinct()
    now = _joined(now, _confirmed(partners, texts, percent, width))
    rest = materialise(_open_rows(apart("bands", "sig"), least), "open")
    sets = _sets(texts.join(rest.select("id").distinct(), "id", "left_semi"), width)
    now = _joined(now, _links(rest.join(sets, "id"), least, percent))

    of_class = classes.join(now.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    if unique:
        out = sigs.select("id", "n", "digest").join(of_class, "digest", "left")
    else:
        out = sigs.select("id", "n").join(known.select("id", "digest").join(of_class, "digest").select("id", "component"), "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op10_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
