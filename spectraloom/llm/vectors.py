"""Vector tables: valid rows, and groups of rows met by streams of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import tidied


def valid(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, vec (array<double>) of rows without null or non-finite components.

    A null id or vector, an empty vector, one whose length is not the table's
    most frequent one (the least of equals) and, unless ``zero``, one of zeros
    take no part. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec_id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite)
    if not zero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (width.d if width else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def meet(rows: DataFrame, build: Callable, ask: Callable, schema: str) -> DataFrame:
    """Each group's members as one index, its queries streamed past it.

    ``rows``: g, query (boolean), id, vec, bound. ``build(ids, matrix)`` makes the index of
    the members; ``ask(index, ids, matrix, bounds)`` yields column arrays for some
    queries. A group's members are held, its queries are not.
    """
    dealt = rows.select("g", "query", "id", "vec", "bound").repartition("g").sortWithinPartitions("g", "query", "id")
    names = [c.split()[0] for c in schema.split(", ")]

    @tidied
    def work(batches: Iterator[pa.RecordBatch]):
        group, held, index = None, [], None
        for b in batches:
            g, query = b.column("g").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            ids, bound = b.column("id").to_numpy(), b.column("bound").to_numpy(zero_copy_only=False)
            x = matrix(b.column("vec"))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (query[1:] != query[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(g)], strict=True):
                if g[a] != group:
                    group, held, index = g[a], [], None
                if not query[a]:
                    held.append((ids[a:z], x[a:z]))
                    continue
                if not held:
                    continue
                if index is None:
                    index = build(np.concatenate([i for i, _ in held]), np.vstack([v for _, v in held]))
                for columns in ask(index, ids[a:z], x[a:z], bound[a:z]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return dealt.mapInArrow(work, schema)
