"""Approximate nearest neighbours by collision counting on single-projection sorted arrays.

Every vector is indexed under SAMPLES random projections. A query opens a window around its own projection in each sorted array and
widens all of them step by step (virtual rehashing). A vector that lies in enough windows is verified with its exact cosine. The search
of a shard ends when the k-th nearest found lies within the radius the windows stand for, or when all its vectors were verified: a vector
within that radius lies in a window with probability 0.83, so in fewer than 70 % of 64 windows with less than 0.01.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

PROJECTIONS = 64
#: Share of the windows that a vector has to lie in, half the width of a window at radius 1, first radius, and growth of the radius.
COLLISIONS = 0.7
HALF_WIDTH = 1.36
FIRST_RADIUS, GROWTH = 0.2, 1.25
SHARD_ROWS = 8192


def usable(v: Column) -> Column:
    """Not null, not empty, without null or non-finite components and not zero."""
    x = lambda e: e.cast("double")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(x(e)) & (F.abs(x(e)) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda e: e != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Shard:
    """Sorted projections of vectors of one size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by], vectors[by]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.axes = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], PROJECTIONS))
        h = (self.vectors / self.norms[:, None]) @ self.axes
        self.order = np.argsort(h, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(h.T, self.order, axis=1)

    def nearest(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k nearest found, nearest first, ties to the smaller id."""
        n = len(self.ids)
        norm = np.sqrt((q * q).sum())
        at = (q / norm) @ self.axes
        count = np.zeros(n, np.int32)
        score = np.full(n, -np.inf)
        seen = self.ids == own
        lo = hi = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at)])
        need, found, radius = int(np.ceil(COLLISIONS * PROJECTIONS)), 0, FIRST_RADIUS
        while True:
            half = HALF_WIDTH * radius
            new_lo = np.minimum(lo, [np.searchsorted(s, x - half) for s, x in zip(self.sorted, at)])
            new_hi = np.maximum(hi, [np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, at)])
            fresh = [o[a:b] for o, a, b in zip(self.order, new_lo, lo)] + [o[a:b] for o, a, b in zip(self.order, hi, new_hi)]
            count += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            lo, hi = new_lo, new_hi
            pick = np.flatnonzero((count >= need) & ~seen)
            seen[pick] = True
            score[pick] = (self.vectors[pick] * q).sum(axis=1) / (self.norms[pick] * norm)
            found += len(pick)
            covered = (lo == 0).all() and (hi == n).all()
            if covered:
                break
            if found >= k:
                kth = np.partition(score, n - k)[n - k]
                if np.sqrt(max(0.0, 2 - 2 * kth)) <= radius:
                    break
            radius *= GROWTH
        hit = np.flatnonzero(score > -np.inf)
        best = hit[np.lexsort((self.ids[hit], -score[hit]))[:k]]
        return [(int(self.ids[i]), float(score[i])) for i in best]


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` picks its k nearest rows of all, by cosine in double precision.

    Vectors fall into shards of about `shard_rows` by a hash of the key; a task holds the index of a shard and streams the queries past
    it, so memory is bounded by a shard and an Arrow batch. Rows whose key is null or whose vector is null, empty, zero or holds null or
    non-finite components take no part. Rows with the query's own key are no candidates; a key that repeats asks once for each distinct
    vector. Vectors meet only vectors of their own size. Fewer candidates than k give as many rows.
    """
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q")).where(F.col("id").isNotNull() & usable(v))
    shards = max(1, -(-rows.count() // shard_rows))
    data = rows.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "id", "v")
    asked = rows.where("q").select("id", "v").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "id", "v")
    dealt = data.unionByName(asked).repartition("shard", "dim").sortWithinPartitions("shard", "dim", "kind", "id")

    def run(batches):
        group, shard = None, None
        ids, vecs = [], []
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            keys = np.stack(cols[:3])
            edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                own = (cols[0][a], cols[1][a])
                m = _matrix(batch.column(4).slice(a, b - a))
                if own != group:
                    group, shard, ids, vecs = own, None, [], []
                if cols[2][a] == 0:
                    ids.append(cols[3][a:b])
                    vecs.append(m)
                    continue
                if not ids:
                    continue
                shard = shard or Shard(np.concatenate(ids), np.concatenate(vecs))
                out = [(int(q), *hit) for q, x in zip(cols[3][a:b], m) for hit in shard.nearest(int(q), x, k)]
                q, i, s = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    nearest = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
