"""Stored ion index and spectra cache, and estimates of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators import ions as io
from spectraloom.operators.mods import variant_count
from spectraloom.params import SearchParams


def save(entries: DataFrame, p: SearchParams, table: str, buckets: int = 64) -> DataFrame:
    """The matchable ions of ``entries`` as a table bucketed and sorted by bin, so that searches need no shuffle of it."""
    ions = io.matchable(io.fragments(entries, p), p)
    ions.write.bucketBy(buckets, "bin").sortBy("bin", "mass_e8").mode("overwrite").saveAsTable(table)
    return entries.sparkSession.table(table)


def estimate(peptides: DataFrame, p: SearchParams) -> DataFrame:
    """One row: peptides, variants, spectra (both together), ions, index_mb."""
    counted = peptides.withColumn("v", variant_count(F.col("seq"), p))
    ions = (F.col("len") - 1) * (2 * p.max_charge) * (F.col("v") + 1)
    out = counted.agg(F.count("*").alias("peptides"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("variants"), F.coalesce(F.sum(ions), F.lit(0)).cast("long").alias("ions"))
    return out.withColumn("spectra", F.col("peptides") + F.col("variants")).withColumn("index_mb", memory_mb(F.col("ions"), 1, p))


def memory_mb(ions, tasks: int, p: SearchParams, scratch_mb: float = 0.0):
    """Memory model: four bytes an ion, four a bin and task, scratch space of each task."""
    return (ions * 4 + tasks * p.max_mass * p.scale * 4) / (1 << 20) + scratch_mb * tasks


def shuffle_partitions(ions: int, mb_each: int = 128) -> int:
    """Partitions of a shuffle of the index (about 32 bytes an ion) of ``mb_each`` MB."""
    return max(1, -(-ions * 32 // (mb_each << 20)))


def cached_spectra(spark: SparkSession, raw: DataFrame, path: str, p: SearchParams, files: list[str]) -> DataFrame:
    """Picked spectra from the Parquet cache at ``path``, partitioned by file; only files that it lacks are prepared.

    ``reindex`` prepares all again, ``nocache`` reads the raw spectra and stores nothing.
    """
    from spectraloom.operators.spectra import picked_arrays, with_defaults

    if p.nocache:
        return picked_arrays(with_defaults(raw), p)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    known = set() if p.reindex or not there else {r.file for r in spark.read.parquet(path).select("file").distinct().collect()}
    missing = [f for f in files if f not in known]
    if missing:
        made = picked_arrays(with_defaults(raw.filter(F.col("file").isin(missing))), p)
        made.write.partitionBy("file").mode("append" if known else "overwrite").parquet(path)
    return spark.read.parquet(path)
