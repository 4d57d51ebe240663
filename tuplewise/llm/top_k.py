"""Operator 2: exact top-k search by no-random-access aggregation.

Each dimension is a list of the candidates by value. For a query, the lists
that weigh most are read to their end and of each other list the good end: the
top for a positive weight, the bottom for a negative one. A candidate's score
then has an upper bound (what was read of it, and the value that each other
list has come to) and a lower bound (what was read, and each other list's worst
value). Candidates whose upper bound lies under the k-th lower bound can't
qualify; the others' lists are read on, and where they end scores are exact.

Queries are a stated set; they meet all rows in blocks of bounded size, and
each block returns at most k rows a query. A first pass over one block for each
query gives a k-th score, which is the least that counts in all other blocks,
so there reading stops early. The bounds of a block of queries against a block
of candidates are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, require

#: Rows of a block of candidates and of queries, and queries bounded at a time.
CANDIDATES, QUERIES_, AT_A_TIME = 4096, 4096, 128
#: Shares of the lists that are read to the end before bounds are compared, and of the others that is read.
HEAVY, LIGHT = (3 / 4, 7 / 8), 1 / 4
#: No least score is known.
NONE = np.iinfo(np.int64).min


def best_of_block(queries: np.ndarray, own: np.ndarray, least: np.ndarray, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int, read: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, score) of each query's k best rows.

    own and keys tell a query's own row among the rows; only scores of at least
    `least` count. Best by score, then smaller id. Integers throughout: floats
    where every partial sum is exact in them, else int64. OverflowError where
    int64 can't hold it. read gets the shares of list entries read.
    """
    none = np.empty(0, np.int64)
    if not len(queries) or not len(rows):
        return none, none, none
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if largest >= 2**63:
        raise OverflowError("scores don't fit in 64 bits")
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    x, (n, dims) = rows.astype(kind), rows.shape
    lists = np.sort(x, axis=0)
    low, high = lists[0], lists[-1]
    depth = max(1, int(n * LIGHT))
    down, up = lists[n - depth], lists[depth - 1]  # where the lists have come to, from the top and from the bottom
    # For positive and negative weights: what an entry is at most, and at least in effect.
    most = np.maximum(x, down), np.minimum(x, up)
    least_of = np.where(x >= down, x, low), np.where(x <= up, x, high)
    table, worst = np.hstack([x, *most]), np.hstack([x, *least_of])
    out = []
    for at in range(0, len(queries), AT_A_TIME):
        q, floor = queries[at : at + AT_A_TIME].astype(kind), least[at : at + AT_A_TIME].copy()
        mine = own[at : at + AT_A_TIME, None] == keys[None, :]
        order = np.argsort(-np.abs(q) * (high - low), axis=1, kind="stable")
        heavy = np.zeros(q.shape, bool)
        np.put_along_axis(heavy, order[:, : int(dims * HEAVY[0])], True, axis=1)
        rest = np.where(heavy, 0, q)
        weights = np.hstack([np.where(heavy, q, 0), np.maximum(rest, 0), np.minimum(rest, 0)])
        upper = weights @ table.T
        open_ = np.flatnonzero(floor == NONE)
        if len(open_) and n > k:
            lower = weights[open_] @ worst.T
            lower[mine[open_]] = NONE
            floor[open_] = np.partition(lower, n - k, axis=1)[:, n - k]
        alive = (upper >= floor.astype(kind)[:, None]) & ~mine
        done = int(dims * HEAVY[0]) + (dims - int(dims * HEAVY[0])) * depth / n
        for i in range(len(q)):
            left = np.flatnonzero(alive[i])
            if read is not None:
                read.append((done + (dims - done) * len(left) / n) / dims)
            for share in HEAVY[1:]:
                if len(left) <= 4 * k:
                    break
                part, whole = x[left], order[i, : int(dims * share)]
                bound = np.where(q[i] > 0, most[0][left], most[1][left])
                bound[:, whole] = part[:, whole]
                under = np.where(q[i] > 0, least_of[0][left], least_of[1][left])
                under[:, whole] = part[:, whole]
                floor[i] = max(floor[i], int(np.partition(under @ q[i], len(left) - k)[len(left) - k]))
                left = left[bound @ q[i] >= floor[i]]
            score = x[left] @ q[i]
            best = np.lexsort((ids[left], -score))[:k]
            out.append((np.full(len(best), at + i), left[best], score[best].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return (query_id, rank, vec_id, score): the k best rows of each query.

    Components are floor(scale * x). Queries are the rows where is_query
    holds; candidates all rows but the query's own. Best is the highest inner
    product, ties go to the smaller id; fewer than k candidates give fewer
    rows. Null vectors, and vectors with null or non-finite components, take
    no part, nor do rows with a null id. Vectors of different lengths have no
    score. Rows that repeat an id are queries and candidates each. An empty
    table gives no rows; other columns, whatever their names, are not read.
    OverflowError if a score needs more than 64 bits.
    """
    require(vectors, id_col, vector_col)
    ok = vectors.filter(_usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = ok.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), _whole(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    rows = materialise(rows, "vectors")  # so that a row has one number
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    across, down = (max(1, -(-n // each)) for n, each in ((sizes.n, CANDIDATES), (sizes.q, QUERIES_)))
    placed = rows.select("row", "id", "v", F.pmod("row", F.lit(across)).cast("int").alias("c"), F.lit(1).alias("side"), F.lit(NONE).alias("least"))
    queries = rows.filter("q").select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(down)).cast("int").alias("d"), F.lit(0).alias("side"))

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        side, row, ids, least = (t.column(c).to_numpy() for c in ("side", "row", "id", "least"))
        flat = t.column("v").combine_chunks()
        flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
        v, a = flat.reshape(len(ids), -1), side == 0
        query, found, score = best_of_block(v[a], row[a], least[a], v[~a], row[~a], ids[~a], k)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (row[a][query], ids[a][query], ids[~a][found], score)], names=["query", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if held and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(3)):
                    yield solve(held)
                    held = []
                held.append(part)
        if held:
            yield solve(held)

    def met(one: DataFrame, two: DataFrame) -> DataFrame:
        both = one.unionByName(two).select("c", "d", F.size("v").alias("size"), "side", "row", "id", "v", "least")
        cells = both.repartition("c", "d", "size").sortWithinPartitions("c", "d", "size", "side")
        return cells.mapInArrow(run, "query long, query_id long, vec_id long, score long")

    none = F.lit(NONE).alias("least")
    if across > 1:
        # Each block of queries meets one block of rows first.
        one = placed.filter(F.col("c") < down).withColumn("d", F.explode(F.expr(f"sequence(c, {down - 1}, {across})")))
        first = met(one, queries.withColumn("c", F.pmod("d", F.lit(across))).select("*", none))
        known = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
        queries = queries.join(materialise(known.select(F.col("query").alias("row"), "least"), "least"), "row", "left").withColumn("least", F.coalesce("least", none))
    else:
        queries = queries.select("*", none)
    found = met(placed.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))), queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Five best rows of every fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)
