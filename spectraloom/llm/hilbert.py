"""Approximate nearest neighbours along shifted Hilbert curves.

Each ordering projects the vectors on a few random directions, places them on
a shifted grid (cells of equal counts in a sample) and reads off the Hilbert
index of their cell. Quantiles of the index cut an ordering into key ranges; a
query meets the ranges around its own in every ordering, and the exact distance
ranks what it met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm import vectors
from spectraloom.llm.common import hash_sample, stored, tidied


@dataclass(frozen=True)
class Settings:
    """orderings, dims, bits: curves, directions and bits a direction of each.
    window: share of an ordering on either side of a query that it meets.
    ranges, range_rows: least key ranges of an ordering, and rows of a range on average.
    least_rows: rows of a range at least on average, so that queries of a small table meet all of it.
    sample: rows (about; by id hash) that the grid and the ranges are fitted on; every row is indexed.
    """

    k: int = 10
    orderings: int = 8
    dims: int = 4
    bits: int = 10
    window: float = 0.1
    ranges: int = 30
    range_rows: int = 4096
    least_rows: int = 64
    sample: int = 20_000
    seed: int = 11


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims), by Gray-code rotation from the highest bit down."""
    x, one = cells.astype(np.uint64).copy(), np.uint64(1)
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, under = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            on = (x[:, i] & bit) > 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & under)
            x[:, 0] ^= np.where(on, under, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[:, -1] & np.uint64(1 << level)) > 0, turn ^ np.uint64((1 << level) - 1), turn)
    x ^= turn[:, None]
    out = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[:, i] >> np.uint64(level)) & one)
    return out


class Curves:
    """Projections, grids and key ranges of all orderings, fitted on sample rows."""

    def __init__(self, sample: np.ndarray, ranges: int, s: Settings):
        rng, width = np.random.default_rng(s.seed), sample.shape[1]
        self.s, self.parts = s, []
        for _ in range(s.orderings):
            direction = rng.normal(size=(width, s.dims))
            direction /= np.linalg.norm(direction, axis=0)
            seen = np.sort(sample @ direction, axis=0)
            shift = rng.random(s.dims) * 0.05
            part = [direction, seen, shift, None]
            self.parts.append(part)
            keys = np.sort(self._keys(sample, part))
            part[3] = keys[(np.arange(1, ranges) * len(keys)) // ranges]

    def _keys(self, x: np.ndarray, part: list) -> np.ndarray:
        direction, seen, shift, _ = part
        y = x @ direction
        place = np.column_stack([np.searchsorted(seen[:, i], y[:, i], "right") for i in range(y.shape[1])]) / max(1, len(seen))
        cell = np.minimum((place * 0.95 + shift) * (1 << self.s.bits), (1 << self.s.bits) - 1)
        return hilbert_index(cell.astype(np.uint64), self.s.bits)

    def ranges(self, x: np.ndarray) -> np.ndarray:
        """(rows, orderings): the key range of each vector."""
        return np.column_stack([np.searchsorted(p[3], self._keys(x, p), "right") for p in self.parts]).astype(np.int64)


def search(table: DataFrame, every: int, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by ``every``, the k nearest others found.

    The score is the Euclidean distance of the original vectors. A key range
    with more rows than planned (many equal vectors) is split and its queries
    meet all parts. Vectors that are null, all zero or hold null or non-finite
    components take no part; rows of one vec_id count once (as a query the least
    vector) and are not candidates of that id; ties go to the smaller vec_id; an empty table gives
    no rows.
    """
    s = settings
    whole = stored(vectors.valid(table, zero=False))
    n = whole.count()
    schema = "query_id long, vec_id long, score double"
    if not n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranges = min(max(s.ranges, math.ceil(n / s.range_rows)), max(1, n // s.least_rows))
    reach = math.ceil(ranges * s.window)
    sample = hash_sample(whole, "vec_id", n, s.sample).toArrow().sort_by("vec_id").column("vec").combine_chunks()
    curves = Curves(vectors.matrix(sample), ranges, s)

    @tidied
    def place(batches):
        for b in batches:
            at = curves.ranges(vectors.matrix(b.column("vec"))) if b.num_rows else np.zeros((0, s.orderings), np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), s.orderings).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), lists], ["vec_id", "vec", "at"])

    placed = stored(whole.mapInArrow(place, "vec_id long, vec array<double>, at array<long>"))
    rows = placed.select("vec_id", "vec", F.posexplode("at").alias("o", "r"))
    parts = stored(rows.groupBy("o", "r").agg(F.count("*").alias("c")).select("o", "r", F.ceil(F.col("c") / (2 * max(s.range_rows, math.ceil(n / ranges)))).alias("parts")))
    key = F.xxhash64("o", "r", "p").alias("g")
    none = F.lit(None).cast("double").alias("bound")
    members = rows.join(parts, ["o", "r"]).withColumn("p", F.pmod(F.xxhash64("vec_id"), "parts")).select(key, F.lit(False).alias("query"), F.col("vec_id").alias("id"), "vec", none)
    asked = placed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "at")).alias("q"))
    queries = asked.select("vec_id", "q.vec", F.posexplode("q.at").alias("o", "r")).withColumn("r", F.explode(F.sequence(F.col("r") - reach, F.col("r") + reach)))
    queries = queries.join(parts, ["o", "r"]).withColumn("p", F.explode(F.expr("sequence(0L, parts - 1L)"))).select(key, F.lit(True).alias("query"), F.col("vec_id").alias("id"), "vec", none)

    def build(ids, rows):
        return ids, rows, (rows * rows).sum(1)

    def ask(index, ids, x, _):
        names, rows, squares = index
        for a in range(0, len(ids), 64):
            part = x[a : a + 64]
            rough = squares[None] - 2 * part @ rows.T
            rough[ids[a : a + 64, None] == names[None]] = np.inf
            slack = 1e-9 * (1 + squares.max() + (part * part).sum(1))
            k = min(s.k, len(names)) - 1
            cut = np.partition(rough, k, axis=1)[:, k] + slack
            q, j = np.nonzero((rough <= cut[:, None]) & np.isfinite(rough))
            exact = np.sqrt(((part[q] - rows[j]) ** 2).sum(1))
            order = np.lexsort((names[j], exact, q))
            q, j, exact = q[order], j[order], exact[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < s.k
            yield [ids[a : a + 64][q[keep]], names[j[keep]], exact[keep]]

    near = vectors.meet(members.union(queries), build, ask, schema)
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
