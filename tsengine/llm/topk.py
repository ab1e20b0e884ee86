"""Exact top-k search by pivot-table elimination (operator 9).

Vectors become integers floor(scale * x). With the distance of every vector to many pivots in a
table, max over pivots |d(q, p) - d(v, p)| is a lower bound of the distance of q and v, hence
(|q|^2 + |v|^2 - bound^2) / 2 an upper bound of their inner product. A task holds a block of queries
and a slice of candidates; each query evaluates them in the order of the bound, in rounds that double,
and stops once its k-th score beats every bound that is left. Scores are exact integers.

The pivots come from a bounded sample (``pivots`` rows by a hash of the id); every row is in the
table. Queries go in blocks of ``BLOCK`` rows; every candidate meets every block, so the work is
queries times rows divided over all tasks, and no list of pairs exists.

Vectors that are null, empty, or hold a null or non-finite component take no part; vectors of
different lengths never meet. A query does not meet rows of its own vec_id. Rows that share a
vec_id are candidates of their own; as a query the least of their vectors stands for them. Null
ids take no part. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.llm.common import small_batches

BLOCK = 1024      # queries of a block, about
SLICE = 16384     # candidates of a slice, about
PIVOTS = 32
EXACT = float(2**53)


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q and v; floats serve where their sums are exact."""
    worst = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if worst < EXACT:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _distances(x: np.ndarray, norms: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norms[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T), 0))


class _Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries

    def least(self, i: int) -> int | None:
        return int(self.score[i][-1]) if len(self.score[i]) == self.k else None

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate([self.score[i], score]), np.concatenate([self.ids[i], ids])
        top = np.lexsort((d, -s))[:self.k]
        self.score[i], self.ids[i] = s[top], d[top]


def _search(best: _Best, qid, q, qn, qd, vid, v, vn, vd) -> None:
    """Offer the candidates to every query, in bound order, until no bound can win or tie."""
    slack = 1e-9
    for i in range(len(qid)):
        low = np.abs(vd - qd[i]).max(axis=1)
        bound = (qn[i] + vn - low * low * (1 - slack)) / 2 + slack * (qn[i] + vn) + 0.5
        bound[vid == qid[i]] = -np.inf
        least = best.least(i)
        alive = np.flatnonzero(bound >= least) if least is not None else np.flatnonzero(bound > -np.inf)
        alive = alive[np.argsort(-bound[alive], kind="stable")]
        at, size = 0, 64
        while at < len(alive):
            take = alive[at:at + size]
            least = best.least(i)
            if least is not None and bound[take[0]] < least:
                break
            best.add(i, _products(q[i:i + 1], v[take])[0], vid[take])
            at, size = at + size, size * 2


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query row with
    all rows but its own; ties go to the smaller vec_id."""
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col("embedding")
    usable = (F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("x"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"))
    dims = [r[0] for r in rows.select(F.size("x").alias("n")).distinct().orderBy("n").collect()]  # lengths, not rows
    parts = [_of_length(rows.where(F.size("x") == d).select("vec_id", "x", "is_query"), d, k, pivots) for d in dims]
    found = parts[0] if parts else spark.createDataFrame([], "query_id long, vec_id long, score long")
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, dim: int, k: int, pivots: int) -> DataFrame:
    spark = rows.sparkSession
    pivot_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("x").collect()
    p = np.array([r.x for r in pivot_rows], np.float64).reshape(-1, dim)
    queries = rows.where("is_query").select("vec_id", "x").groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = max(1, -(-queries.count() // BLOCK))
    # a query block is packed into one row of at most a few times BLOCK vectors, by a hash of the id
    packed = (queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
              .agg(F.collect_list(F.struct("vec_id", "x")).alias("queries")))
    shared = spark.sparkContext.broadcast(p)
    # every candidate meets every block: candidates are dealt to (block, slice)
    slices = max(1, -(-rows.count() // SLICE))
    dealt = (rows.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                         F.pmod(F.xxhash64("vec_id", "x"), F.lit(slices)).cast("int").alias("slice")))
    heads = packed.select("block", "queries", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qs = left.column("queries").to_pylist()[0] if left.num_rows else []
        best = _Best(len(qs), k)
        qid = np.array([r["vec_id"] for r in qs], np.int64)
        if len(qs) and right.num_rows:
            p = shared.value
            q = np.array([r["x"] for r in qs], np.float64).reshape(-1, dim)
            qn = (q * q).sum(axis=1)
            vid, v = right.column("vec_id").to_numpy(), _matrix(right.column("x"), dim)
            vn = (v * v).sum(axis=1)
            _search(best, qid, q, qn, _distances(q, qn, p), vid, v, vn, _distances(v, vn, p))
        n = [len(x) for x in best.score]
        return pa.table({"query_id": pa.array(np.repeat(qid, n), pa.int64()),
                         "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *best.ids]), pa.int64()),
                         "score": pa.array(np.concatenate([np.zeros(0, np.int64), *best.score]), pa.int64())})

    return (heads.groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice"))
            .applyInArrow(run, "query_id long, vec_id long, score long"))
