"""What the corpus operators share: reading, scratch tables, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.memory import ease

#: Text bytes that one numpy step works on (its arrays stay in a core's cache); a longer text is a step of its own.
CHUNK_BYTES = 1 << 17


#: Bytes of an Arrow batch between Spark and Python, so that a worker holds few texts at a time.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``; the session's Arrow batches become at most ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset and Spark is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/spectraloom-scratch"
    return f"{root}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    ease(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished, unreferenced plans; Python's cycles may still refer to one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no result needs them."""
    jvm, path = spark.sparkContext._jvm, scratch_dir(spark)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bucket_of(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(col).cast("string")) % mod


def hash_sample(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """About ``most`` of the ``rows`` rows of ``df``, by the hash of a key; never more than twice as many, no sort."""
    if rows > most:
        df = df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / rows))
    return df.orderBy(F.xxhash64(key), key).limit(2 * most)


def tidied(work):
    """``work`` on Arrow batches; behind it, a worker that lives on gives memory back that it no longer uses."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


# --- words of many texts at once ---------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_RADIX_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _RADIX, np.uint64), np.full(n, _RADIX_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges whose texts have at most ``limit`` bytes together, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lower-cased words ``[^\\x20\\x09-\\x0D]+`` and, per row, where its words begin (n+1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[raw]
    gap = _SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~gap
    before = np.empty(n, bool)
    before[0] = True
    np.logical_or(gap[:-1], edge[1:n], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_or(gap[1:], edge[1:n], out=after[:-1])
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, offsets).astype(np.int64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word runs of one text; with fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(width, n)
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h += words[i : n - k + 1 + i] * _PLACE[i]
    return np.unique(mix(h))


# --- connected components ----------------------------------------------------


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): for each id of ``edges`` (a, b) the smallest id it reaches; an error if ``rounds`` do not settle it.

    Alternating large and small stars; each round is written to the shared
    folder, and hubs are pre-aggregated before each shuffle. Ids without an edge
    are not returned.
    """

    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        """a > b in and out."""
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            made = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            low = e.groupBy("a").agg(F.min("b").alias("m"))
            made = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            made = made.union(low.select("a", F.col("m").alias("b")))
        return made.filter("a > b").distinct()

    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e)
    last = summary(e)
    for _ in range(rounds if last[0] else 0):
        before, e = e, stored(star(star(e, True), False))
        now = summary(e)
        discard(before)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
