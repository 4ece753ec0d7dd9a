"""Exact top-k inner products over norm-sorted vectors.

Components become whole numbers, floor(scale * x). Vectors are dealt into blocks by descending length, so that the
longest of a block bounds every inner product with it (Cauchy-Schwarz). A first pass over the longest vectors gives
each query a score that its k-th best cannot fall below; only blocks that can still reach it meet the query. Within
a block, vectors are rotated into the basis of the singular vectors of all vectors: a partial sum over the leading
components plus the product of the residual lengths bounds the whole sum, and only what passes is summed exactly: a
few pairs at a time, or, where many pass, all pairs of a slice as one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import materialise, runs

SCALE = 1024
BLOCK_ROWS, QUERY_ROWS, HEAD_ROWS = 16384, 2048, 2048
#: Relative slack of bounds that are computed in floating point.
SLACK = 1e-9
#: Beyond this a sum of products could leave 64 bits, and beyond this the whole numbers that a double holds.
EXACT, WHOLE = 2.0**62, 2.0**53
#: Candidates of a slice, and pairs whose vectors are copied side by side at once.
SLICE, PAIRS = 1024, 16384


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q array<double> of whole numbers, norm); vectors that are null, empty of numbers or not finite are left out."""
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    bad = F.exists(F.col("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    q = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))
    return q.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)))


def matrix(column: pa.Array | list, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    out = np.zeros((len(column), dim))
    for k, row in enumerate(column):
        values = row.values.to_numpy(zero_copy_only=False) if isinstance(row, pa.ListScalar) else np.asarray(row)
        out[k, : len(values)] = values
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, leading first, from the summed Gram matrices of the partitions."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column("q"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "part"])

    parts = vectors.select("q").mapInArrow(gram, "row int, part array<double>")
    sums = parts.groupBy("row").agg(F.array(*[F.sum(F.col("part")[k]) for k in range(dim)]).alias("total"))  # dim rows of dim numbers
    whole = np.array([r.total for r in sums.orderBy("row").collect()])
    return np.linalg.eigh(whole)[1][:, ::-1] if len(whole) else np.eye(dim)


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of matching rows of whole numbers, in integers; held to 64 bits at the end."""
    if not len(x):
        return np.zeros(0, np.int64)
    if np.abs(x).max() * np.abs(y).max() * x.shape[1] < EXACT:
        return (x.astype(np.int64) * y.astype(np.int64)).sum(1)
    limit = 2**63 - 1
    return np.array([max(-limit - 1, min(limit, sum(int(a) * int(b) for a, b in zip(u, v)))) for u, v in zip(x, y)], np.int64)


def passing(q: np.ndarray, c: np.ndarray, may: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, exact scores) of the pairs of ``may``; of those under their row's floor some may be left out.

    Vectors are not copied for more than ``PAIRS`` pairs at once, however many there are.
    """
    some, others = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    if np.count_nonzero(may) * 32 > len(some) * len(others) and np.linalg.norm(q[some], axis=1).max() * np.linalg.norm(c[others], axis=1).max() < WHOLE / 2:
        score = q[some] @ c[others].T  # no partial sum is larger than the product of both lengths, so all are exact
        rows, cols = np.nonzero(may[np.ix_(some, others)] & (score >= floor[some, None]))
        return some[rows], others[cols], score[rows, cols].astype(np.int64)
    rows, cols = np.nonzero(may)
    parts = [exact_scores(q[rows[k : k + PAIRS]], c[cols[k : k + PAIRS]]) for k in range(0, len(rows), PAIRS)]
    return rows, cols, np.concatenate(parts) if parts else np.zeros(0, np.int64)


def best(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller name."""
    return np.lexsort((names, -score))[:k]


def search(q: np.ndarray, q_names: np.ndarray, floor: np.ndarray, c: np.ndarray, c_names: np.ndarray, basis: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in a block, of those not below the query's floor.

    Candidates come longest first in slices; a query leaves when the longest left cannot reach its k-th best.
    """
    lead = max(1, basis.shape[1] // 4)
    order = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
    c, c_names = c[order], c_names[order]
    c_norm, q_norm = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    qr, cr = q @ basis, c @ basis
    q_rest, c_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    floor, found = floor.astype(float).copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q]
    # Score and name of each query's k-th best; of equal scores only smaller names can replace it.
    least, last = np.full(len(q), np.iinfo(np.int64).min), np.full(len(q), np.iinfo(np.int64).max)
    live = np.arange(len(q))
    for at in range(0, len(c), SLICE):
        room = SLACK * (1 + q_norm * (c_norm[at] if len(c) else 0))
        live = live[q_norm[live] * c_norm[at] + room[live] >= floor[live]]
        if not len(live):
            break
        some = slice(at, at + SLICE)
        bound = qr[live, :lead] @ cr[some, :lead].T + q_rest[live, None] * c_rest[None, some] + room[live, None]
        rows, cols, score = passing(q[live], c[some], (bound >= floor[live, None]) & (q_names[live, None] != c_names[None, some]), floor[live])
        held = least[live[rows]]
        better = (score > held) | (score == held) & (c_names[at + cols] < last[live[rows]])
        rows, cols, score = rows[better], cols[better], score[better]
        starts = np.searchsorted(rows, np.arange(len(live) + 1))
        for k_live, (a, b) in enumerate(zip(starts, starts[1:])):
            if a == b:
                continue
            i = live[k_live]
            s, n = np.concatenate([found[i][0], score[a:b]]), np.concatenate([found[i][1], c_names[at + cols[a:b]]])
            top = best(s, n, k)
            found[i] = s[top], n[top]
            if len(top) == k:
                floor[i], least[i], last[i] = max(floor[i], float(s[top[-1]])), s[top[-1]], n[top[-1]]
    return [(int(q_names[i]), int(n), int(s)) for i, (ss, ns) in enumerate(found) for s, n in zip(ss, ns)]


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector the k highest inner products with the other vectors.

    Ties: the smaller vec_id first. Nulls: vectors that are null or hold null or non-finite components take no part,
    nor do rows without vec_id. Vectors of different lengths: the shorter count as followed by zeros; an empty vector
    is all zeros. Repeated vec_ids: each row is a candidate, none of its own id. Scores beyond 64 bits are held at
    its ends. Empty tables: an empty result. Other columns are not read.
    """
    every = materialise(quantised(vectors), "vectors")
    asked = quantised(queries)
    size = every.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    dim, blocks = max(1, size.dim or 1), max(1, -(-size.n // BLOCK_ROWS))
    spark = every.sparkSession
    basis = spark.sparkContext.broadcast(rotation(every, dim))  # dim x dim
    dealt = every.repartitionByRange(blocks, F.col("norm").desc(), F.xxhash64("vec_id")).withColumn("block", F.spark_partition_id())
    dealt = materialise(dealt, "blocks")
    longest = [r.longest for r in dealt.groupBy("block").agg(F.max("norm").alias("longest")).orderBy("block").collect()]  # a number per block
    longest = np.array(longest) if len(longest) == blocks else np.full(blocks, max(longest, default=0.0))
    head = every.orderBy(F.col("norm").desc(), "vec_id").limit(HEAD_ROWS).select("vec_id", "q").collect()  # at most HEAD_ROWS vectors
    first = spark.sparkContext.broadcast((matrix([r.q for r in head], dim), np.array([r.vec_id for r in head], np.int64)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = first.value
        for batch in batches:
            q, own = matrix(batch.column("q"), dim), batch.column("vec_id").to_numpy()
            low = np.full(len(q), -np.inf)
            for at in range(0, len(q), 256):
                score = q[at : at + 256] @ c.T
                score[own[at : at + 256, None] == names[None, :]] = -np.inf
                if score.shape[1] >= k:
                    low[at : at + 256] = np.partition(score, -k, axis=1)[:, -k]
            low -= SLACK * np.abs(low)
            norm = batch.column("norm").to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(norm > 0, (low - 2 * SLACK) / (norm * (1 + SLACK)), np.where(low <= SLACK, -np.inf, np.inf))
            reach = np.maximum(1, np.searchsorted(-longest, -need, "right"))  # blocks whose longest vector can reach the floor
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(low), pa.array(reach)], ["query_id", "q", "floor", "reach"])

    ready = materialise(asked.mapInArrow(floors, "query_id long, q array<double>, floor double, reach long"), "queries")
    chunks = max(1, -(-ready.count() // QUERY_ROWS))
    ready = ready.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(chunks)))
    # Blocks lie by descending length: those that a query can still use are the first ones.
    meets = ready.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("reach").cast("int") - 1)) if blocks > 1 else F.lit(0)).select("block", "chunk", F.col("query_id").alias("name"), "q", "floor")
    chosen = meets.select("block", "chunk").distinct()
    met = dealt.join(chosen, "block").select("block", "chunk", F.col("vec_id").alias("name"), "q", F.lit(None).cast("double").alias("floor"))
    both = meets.withColumn("asks", F.lit(True)).union(met.withColumn("asks", F.lit(False))).repartition("block", "chunk").sortWithinPartitions("block", "chunk")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, ("block", "chunk")):
            asks, names, floor = np.array(rows["asks"], bool), np.array(rows["name"], np.int64), np.array([-np.inf if f is None else f for f in rows["floor"]])
            all_q = matrix(rows["q"], dim)
            found = search(all_q[asks], names[asks], floor[asks], all_q[~asks], names[~asks], basis.value, k)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
