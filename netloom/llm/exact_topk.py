"""Exact top-k inner products over norm-sorted vectors.

Vectors are processed by descending length in blocks, in a basis rotated by the singular vectors of all of them. A block whose
largest length times the query's can't reach the query's k-th best score is skipped whole. Inside a block, partial sums over
leading rotated dimensions plus the Cauchy-Schwarz bound of the rest prune vectors; survivors are scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import prepare, read, stored


#: Components and scores end here: 2^62.
LARGEST = float(1 << 62)


def scaled(vector: str, factor: int = 64) -> Column:
    """floor(factor * x) of each component; null for a null vector or one with a null or non-finite component.

    Values beyond 2^62 count as 2^62, with their sign.
    """
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(F.greatest(F.least(v * factor, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long")))


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the right singular vectors of all vectors, the largest first: from their Gram matrix, summed over partitions."""

    def gram(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in parts:
            x = _matrix(batch.column("v"), size).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = vectors.select("v").mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    total = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # size x size sums
        total[r.i, r.j] = r.x
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of integers; shorter vectors end with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(lengths) and (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of rows with a vector; beyond 2^62 they are 2^62, with their sign."""
    if bound < LARGEST:
        return x @ q
    whole = x.astype(object) @ q.astype(object)
    return np.array([max(-(1 << 62), min(1 << 62, int(s))) for s in whole], np.int64)


def search_block(q: np.ndarray, q_uids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_uids: np.ndarray, x_ids: np.ndarray, basis: np.ndarray, k: int, head: int, step: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores in `x` that may be among its k best, given that scores below `floor` are not."""
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((x_uids, x_ids, -norm))
    x, x_ids, x_uids, norm = x[order], x_ids[order], x_uids[order], norm[order]
    rx, rq = x @ basis, q @ basis
    rest_x, rest_q = (np.sqrt((r[:, head:] ** 2).sum(axis=1)) for r in (rx, rq))
    q_norm = np.sqrt((rq**2).sum(axis=1))
    floor = floor.astype(np.float64).copy()
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
    slack = 1e-6 * (1 + q_norm * (norm[0] if len(norm) else 0))  # rounding of the rotated sums
    for at in range(0, len(x), step):
        live = np.flatnonzero(q_norm * norm[at] + slack >= floor)
        if not len(live):
            break
        part = slice(at, at + step)
        bound = rq[live, :head] @ rx[part, :head].T + rest_q[live, None] * rest_x[None, part]
        may = bound + slack[live, None] >= floor[live, None]
        may &= q_uids[live, None] != x_uids[None, part]
        for i, row in zip(live, may, strict=True):
            cols = np.flatnonzero(row) + at
            if not len(cols):
                continue
            scores = products(x[cols], q[i], q_norm[i] * norm[cols[0]] * 1.01)
            good = scores >= floor[i]
            kept[i].append((cols[good], scores[good]))
            have = np.concatenate([s for _, s in kept[i]])
            if len(have) > k:  # the k-th best so far, all ties of it kept
                floor[i] = max(floor[i], np.partition(have, len(have) - k)[len(have) - k])
                kept[i] = [(c[s >= floor[i]], s[s >= floor[i]]) for c, s in kept[i]]
            elif len(have) == k:
                floor[i] = max(floor[i], have.min())
    out = []
    for found in kept:
        cols = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
        best = np.lexsort((x_uids[cols], x_ids[cols], -scores))[:k]
        out.append((order[cols[best]], scores[best]))
    return out


def _search(pairs: DataFrame, basis, size: int, k: int, head: int) -> DataFrame:
    """(query_uid, query_id, vec_id, uid, score): the k best of each (query block, candidate block) pair, whose rows arrive in one group."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy().astype(bool)
        x = _matrix(table.column("v"), size)
        ids, uids, floor = (table.column(c).to_numpy() for c in ("vec_id", "uid", "floor"))
        q_at, x_at = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        found = search_block(x[q_at], uids[q_at], floor[q_at], x[x_at], uids[x_at], ids[x_at], basis.value, k, head)
        n = [len(c) for c, _ in found]
        cols = np.concatenate([c for c, _ in found]) if found else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
        asked, hit = {"query_uid": uids, "query_id": ids}, {"vec_id": ids, "uid": uids}
        columns = {c: pa.array(np.repeat(a[q_at], n), pa.int64()) for c, a in asked.items()} | {c: pa.array(a[x_at][cols], pa.int64()) for c, a in hit.items()}
        return pa.table(columns | {"score": pa.array(scores.astype(np.int64), pa.int64())})

    return pairs.groupBy("qb", "cb").applyInArrow(run, "query_uid long, query_id long, vec_id long, uid long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 4096, query_block: int = 1024, head: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all rows but its own.

    `vectors` has vec_id and v (integers; a null leaves the row out). Ties go to the smaller vec_id. Rows with a null vec_id
    take no part. Rows of a repeated vec_id are rows of their own: each is a candidate of the others, and asks for itself if it
    is a query. Shorter vectors end with zeros. Scores beyond 2^62 are 2^62, with their sign. An empty table, or one without queries, gives an empty result.

    The first, longest block gives each query a floor; the other blocks are then searched only by query blocks they can
    still serve. Query blocks and candidate blocks meet as groups of bounded size, whatever their numbers.
    """
    spark = prepare(vectors.sparkSession)
    given = vectors.filter("vec_id is not null and v is not null").withColumn("uid", F.monotonically_increasing_id())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = stored(given.select("vec_id", "uid", "v", norm.alias("norm"), is_query.alias("is_query")), "topk-rows")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.count_if("is_query").alias("queries")).first()
    if not stats["n"] or not stats["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = stats["size"]
    head = head or max(1, size // 4)
    basis = spark.sparkContext.broadcast(rotation(rows, size))
    blocks = max(1, -(-stats["n"] // block))
    # blocks by descending length: ranges of the norm, and within equal norms a hash
    rings = min(blocks, 200)
    cuts = sorted(set(rows.stat.approxQuantile("norm", [i / rings for i in range(1, rings)], 0.1 / rings)), reverse=True) if rings > 1 else []
    ring = F.lit(0) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("norm")))
    counts = rows.select(ring.alias("ring")).groupBy("ring").count()
    parts = F.ceil(F.col("count") / block).alias("parts")
    placed = rows.withColumn("ring", ring).join(F.broadcast(counts.select("ring", parts)), "ring")  # a row for each cut
    cb = F.concat_ws("-", "ring", F.pmod(F.xxhash64("uid"), "parts"))
    placed = stored(placed.select("vec_id", "uid", "v", "norm", "is_query", "ring", cb.alias("cb")), "topk-blocks")
    lead = placed.orderBy("ring", "cb").select("cb").first()[0]
    query_blocks = max(1, -(-stats["queries"] // query_block))
    queries = placed.filter("is_query").select("vec_id", "uid", "v", "norm", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(query_blocks)).alias("qb"))

    low = F.lit(-(1 << 62)).cast("long")
    shape = ["qb", "cb", "vec_id", "uid", "v", "floor", "is_query"]

    def meet(asking: DataFrame, there: DataFrame, met: DataFrame) -> DataFrame:
        left = asking.join(met, "qb").select("qb", "cb", "vec_id", "uid", "v", "floor", F.lit(True).alias("is_query"))
        right = there.join(met, "cb").select("qb", "cb", "vec_id", "uid", "v", low.alias("floor"), F.lit(False).alias("is_query"))
        return left.select(*shape).unionByName(right.select(*shape))

    every = spark.range(query_blocks).select(F.col("id").alias("qb"))
    first = stored(_search(meet(queries.withColumn("floor", low), placed.filter(F.col("cb") == lead), every.withColumn("cb", F.lit(lead))), basis, size, k, head), "topk-first")
    floors = _best(first, k).filter(F.col("rank") == k).select(F.col("query_uid").alias("uid"), F.col("score").alias("floor"))
    asking = stored(queries.join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", low)), "topk-queries")
    reach = placed.filter(F.col("cb") != lead).groupBy("cb").agg(F.max("norm").alias("longest"))
    # a query block needs no longer vectors than this to reach the floor of one of its queries
    need = asking.groupBy("qb").agg(F.min(F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(F.when(F.col("floor") <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))).alias("need"))
    met = stored(need.join(reach, F.col("longest") * (1 + 1e-9) >= F.col("need")).select("qb", "cb"), "topk-met")
    others = _search(meet(asking, placed, met), basis, size, k, head)
    return _best(first.unionByName(others), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for each twentieth vector."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", scaled("embedding").alias("v"))
    return top_k(rows, F.col("vec_id") % 20 == 0)
