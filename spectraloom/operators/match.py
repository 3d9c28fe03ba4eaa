"""Candidate generation: the mass band join and the fragment bin join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.params import SearchParams


def _mass_buckets(lo: str, hi: str, width: int):
    return F.explode(F.expr(f"sequence(({lo}) div {width}L, ({hi}) div {width}L)"))


def precursor_join(spectra: DataFrame, entries: DataFrame, p: SearchParams) -> DataFrame:
    """spectrum_id, entry_id with |prec_e8 - mass_e8| within dm: an equi-join on mass buckets of twice the tolerance.

    A spectrum touches two buckets, an entry is in one; the band is checked on
    what meets.
    """
    width = max(1, 2 * p.dm_e8)
    left = spectra.select("spectrum_id", "prec_e8", _mass_buckets(f"greatest(0L, prec_e8 - {p.dm_e8}L)", f"prec_e8 + {p.dm_e8}L", width).alias("_m"))
    right = entries.select("entry_id", "mass_e8", F.expr(f"mass_e8 div {width}L").alias("_m"))
    return left.join(right, "_m").filter(F.abs(F.col("prec_e8") - F.col("mass_e8")) <= p.dm_e8).select("spectrum_id", "entry_id")


def query_peaks(spectra: DataFrame, peaks: DataFrame, p: SearchParams) -> DataFrame:
    """spectrum_id, prec_e8, charge, bin, intensity: each picked peak at every bin within df, guarded at the ends."""
    guard = (F.col("bin") > p.df_bins) & (F.col("bin") < p.top_bin - p.df_bins)
    near = F.explode(F.sequence(F.col("bin") - p.df_bins, F.col("bin") + p.df_bins)).alias("bin")
    return peaks.filter(guard).join(spectra.select("spectrum_id", "prec_e8", "charge"), "spectrum_id").select("spectrum_id", "prec_e8", "charge", "intensity", near)


def fragment_join(spectra: DataFrame, peaks: DataFrame, ions: DataFrame, p: SearchParams) -> DataFrame:
    """spectrum_id, entry_id, is_y, intensity of each peak and ion in one bin, precursors within dm.

    A closed search joins on bin and mass bucket, so that hot bins are split by
    mass; an open one on the bin alone, where a skewed partition is split at
    run time. Both sides keep the few columns that the score needs.
    """
    q = query_peaks(spectra, peaks, p)
    i = ions.select("bin", "entry_id", "mass_e8", "is_y", *(["z"] if p.match_charge else []))
    within = F.abs(F.col("prec_e8") - F.col("mass_e8")) <= p.dm_e8
    if p.open_search:
        met = q.join(i, "bin")
    else:
        width = max(1, 2 * p.dm_e8)
        q = q.withColumn("_m", _mass_buckets(f"greatest(0L, prec_e8 - {p.dm_e8}L)", f"prec_e8 + {p.dm_e8}L", width))
        met = q.join(i.withColumn("_m", F.expr(f"mass_e8 div {width}L")), ["bin", "_m"])
    met = met.filter(within)
    if p.match_charge:
        met = met.filter("z <= charge")
    return met.select("spectrum_id", "entry_id", "is_y", "intensity")
