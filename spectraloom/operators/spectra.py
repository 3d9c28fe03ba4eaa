"""Experimental spectra: defaults, integer peaks, peak picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.params import SearchParams


def with_defaults(raw: DataFrame) -> DataFrame:
    """Missing values as the search reads them: charge at least 1, mass 0.01, retention time at least 0."""
    return raw.withColumns({
        "charge": F.greatest(F.lit(1), F.coalesce("charge", F.lit(1))),
        "prec_mass": F.coalesce("prec_mass", F.lit(0.01)),
        "rtime": F.greatest(F.lit(0.0), F.coalesce("rtime", F.lit(0.0))),
    })


def integer_peaks(peaks: DataFrame, p: SearchParams) -> DataFrame:
    """spectrum_id, bin, intensity of rows (spectrum_id, mz, intensity), cut to integers (intensity in hundredths)."""
    return peaks.select("spectrum_id", F.floor(F.col("mz") * p.scale).cast("int").alias("bin"), F.floor(F.col("intensity") * 100).cast("long").alias("intensity"))


def pick(peaks: DataFrame, p: SearchParams) -> DataFrame:
    """The ``top_peaks`` most intense peaks of each spectrum (ties: smaller bin), the largest scaled to ``base``, those under the cutoff dropped.

    Rows (spectrum_id, bin, intensity); the row-number filter becomes a
    partial top-k before the shuffle.
    """
    ranked = peaks.withColumn("_k", F.row_number().over(Window.partitionBy("spectrum_id").orderBy(F.desc("intensity"), "bin"))).filter(F.col("_k") <= p.top_peaks)
    largest = F.max("intensity").over(Window.partitionBy("spectrum_id"))
    scaled = ranked.withColumn("_max", largest).filter("_max > 0").withColumn("intensity", F.expr(f"(intensity * {p.base}L) div _max"))
    return scaled.filter(F.col("intensity") >= p.min_intensity).select("spectrum_id", "bin", "intensity")


def picked_arrays(raw: DataFrame, p: SearchParams) -> DataFrame:
    """``raw`` (peaks array<struct<mz, intensity>>) with peaks as picked (bin, intensity), no shuffle; an empty spectrum keeps an empty array."""
    ints = F.transform("peaks", lambda x: F.struct(F.floor(x["intensity"] * 100).cast("long").alias("i"), (-F.floor(x["mz"] * p.scale)).cast("int").alias("b")))
    best = F.slice(F.sort_array(ints, asc=False), 1, p.top_peaks)
    top = F.get(F.col("_best"), 0)["i"]
    scaled = F.transform("_best", lambda x: F.struct((-x["b"]).alias("bin"), F.floor(x["i"] * F.lit(p.base) / top).cast("long").alias("intensity")))
    return raw.withColumn("_best", best).withColumn("peaks", F.filter(scaled, lambda x: x["intensity"] >= p.min_intensity)).drop("_best")


def summary(peaks: DataFrame, key: str = "spectrum_id") -> DataFrame:
    """Peaks, largest and total intensity of each spectrum."""
    return peaks.groupBy(key).agg(F.count("*").alias("n_peaks"), F.max("intensity").cast("double").alias("max_intensity"), F.sum("intensity").cast("double").alias("sum_intensity"))


def file_summary(raw: DataFrame, batch: int = 10_000) -> DataFrame:
    """file, n_spectra, max_peaks, n_batches, first_batch of a raw spectra table."""
    by = raw.groupBy("file").agg(F.count("*").alias("n_spectra"), F.max(F.size("peaks")).alias("max_peaks"))
    return batches(by.withColumn("n_batches", F.ceil(F.col("n_spectra") / batch)), "file")


def batches(counted: DataFrame, key: str) -> DataFrame:
    """``counted`` (n_batches) with first_batch: the batches of all rows before, by key."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("first_batch", F.coalesce(F.sum("n_batches").over(before), F.lit(0)).cast("long"))


def from_fragments(ions: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Spectra made of the fragments of every n-th entry: (spectrum_id, prec_e8, charge, rtime), peaks.

    Intensities follow the bin, so they are the same in every engine.
    """
    some = ions.filter(F.col("entry_id") % every == 0)
    peaks = some.select(F.col("entry_id").alias("spectrum_id"), "bin").distinct().withColumn("intensity", (F.lit(1000) + (F.col("bin").cast("long") * 7919) % 99000) * 100)
    heads = some.groupBy(F.col("entry_id").alias("spectrum_id")).agg(F.first("mass_e8").alias("prec_e8"))
    return heads.select("spectrum_id", "prec_e8", F.lit(2).alias("charge"), (F.col("spectrum_id") / 10).alias("rtime")), peaks
