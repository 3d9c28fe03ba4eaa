"""Exact top-k inner products: a KD-tree per shard, searched best first."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm import vectors
from spectraloom.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """shard_rows: rows of a shard on average. leaf_rows: most rows of a leaf. scale: components become floor(scale * x)."""

    k: int = 20
    shard_rows: int = 16_384
    leaf_rows: int = 256
    scale: float = 64.0


class KDTree:
    """Median splits on the widest dimension; each node keeps the tight box of its rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int):
        self.ids, self.rows = ids, rows
        self.low, self.high, self.children, self.span = [], [], [], []
        order = np.arange(len(ids))
        self._grow(order, 0, len(ids), leaf_rows)
        self.order, self.low, self.high = order, np.array(self.low), np.array(self.high)
        self.ids, self.rows = ids[order], rows[order]

    def _grow(self, order: np.ndarray, a: int, z: int, leaf_rows: int) -> int:
        me, part = len(self.span), self.rows[order[a:z]]
        low, high = part.min(0), part.max(0)
        self.low.append(low), self.high.append(high), self.span.append((a, z)), self.children.append(None)
        axis = int(np.argmax(high - low))
        if z - a > leaf_rows and high[axis] > low[axis]:
            mid = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(part[:, axis], mid)]
            self.children[me] = (self._grow(order, a, a + mid, leaf_rows), self._grow(order, a + mid, z, leaf_rows))
        return me

    def top(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """Up to k (score, id) of at least ``least``, best first, ties to smaller ids, without ``own``.

        Nodes come from a heap by the greatest inner product that their box
        allows; the search ends when that is below the k-th score so far.
        """
        bound = self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)
        heap, best, kth = [(-bound[0], 0)], [], least
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if (below := self.children[node]) is not None:
                for child in below:
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, z = self.span[node]
            score = self.rows[a:z] @ query
            hit = np.flatnonzero((score >= kth) & (self.ids[a:z] != own))
            if len(hit):
                best = sorted(set(best) | {(-int(score[i]), int(self.ids[a + i])) for i in hit})[:k]
                if len(best) == k:
                    kth = max(kth, -best[-1][0])
        return [(-s, i) for s, i in best]


def search(table: DataFrame, every: int, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by ``every``, its k best others.

    The score is the inner product of components floor(scale * x), exact while
    |scale * x| stays below 2**23. A query first searches its own shard; the
    k-th score found there bounds the search of every other shard, which
    returns only scores that reach it. Vectors that are null or hold null or
    non-finite components take no part; rows of one vec_id count once (their
    best score; as a query the least vector) and are not candidates of that id; ties go to the smaller
    vec_id; an empty table gives no rows.
    """
    s = settings
    whole = vectors.valid(table, zero=True).select("vec_id", F.transform("vec", lambda x: F.floor(x * F.lit(s.scale)).cast("double")).alias("vec"))
    whole = stored(whole)
    shards = max(1, math.ceil(whole.count() / s.shard_rows))
    placed = whole.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    members = placed.select("g", F.lit(False).alias("query"), F.col("vec_id").alias("id"), "vec", F.lit(None).cast("double").alias("bound"))
    queries = placed.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "g").agg(F.min("vec").alias("vec"))
    schema = "query_id long, vec_id long, score long"

    def build(ids, rows):
        return KDTree(ids, rows, s.leaf_rows)

    def ask(tree, ids, rows, bounds):
        found = [(int(q), i, score) for q, x, b in zip(ids, rows, bounds, strict=True) for score, i in tree.top(x, q, s.k, -math.inf if b is None or np.isnan(b) else b)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield [np.array(c, np.int64) for c in columns]

    home = queries.select("g", F.lit(True).alias("query"), F.col("vec_id").alias("id"), "vec", F.lit(None).cast("double").alias("bound"))
    near = stored(vectors.meet(members.union(home), build, ask, schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        bounded = queries.join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("bound", F.when(F.col("n") >= s.k, F.col("kth").cast("double")))
        away = bounded.withColumn("to", F.explode(F.expr(f"sequence(0L, {shards - 1}L)"))).filter("to <> g")
        away = away.select(F.col("to").alias("g"), F.lit(True).alias("query"), F.col("vec_id").alias("id"), "vec", "bound")
        near = near.union(vectors.meet(members.union(away), build, ask, schema))
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
