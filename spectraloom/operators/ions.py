"""Theoretical fragments of peptides and variants, by explodes that codegen compiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.chem import WATER_E8
from spectraloom.functions.peptide import fragment_bin, prefix_sums, residue_masses
from spectraloom.params import SearchParams


def ladders(entries: DataFrame, p: SearchParams, keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """``keep``, mass_e8, sums: masses of no residue, the first, the first two and so on, with the modifications inside; all that fragments are made of.

    ``entries``: seq, mass_e8 and, for variants, mods array<struct<pos, mass_e8>>.
    """
    masses = residue_masses(F.col("seq"))
    if "mods" in entries.columns:
        masses = F.transform(masses, lambda m, i: m + F.aggregate(F.filter("mods", lambda x: x["pos"] == i + 1), F.lit(0).cast("long"), lambda a, x: a + x["mass_e8"]))
    return entries.select(*keep, "mass_e8", F.length("seq").alias("_len"), prefix_sums(masses).alias("sums")).filter("_len > 1").drop("_len")


def fragments(entries: DataFrame, p: SearchParams, keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """``keep``, mass_e8, is_y, z, pos, bin of each b and y fragment.

    ``entries`` as for ``ladders``. A fragment holds the masses of the modifications inside it.
    """
    base = ladders(entries, p, keep).select(*keep, "mass_e8", (F.size("sums") - 1).alias("_len"), F.col("sums").alias("_sums"))
    at = base.select("*", F.explode(F.sequence(F.lit(1), F.col("_len") - 1)).alias("pos"))
    b = F.element_at("_sums", F.col("pos") + 1)
    y = F.element_at("_sums", -1) - F.element_at("_sums", F.col("_len") - F.col("pos") + 1) + F.lit(WATER_E8)
    both = at.select(*keep, "mass_e8", "pos", F.explode(F.array(F.struct(F.lit(0).alias("is_y"), b.alias("m")), F.struct(F.lit(1).alias("is_y"), y.alias("m")))).alias("f"))
    charged = both.select(*keep, "mass_e8", "pos", F.col("f.is_y").alias("is_y"), F.col("f.m").alias("m"), F.explode(F.array(*map(F.lit, range(1, p.max_charge + 1)))).alias("z"))
    return charged.select(*keep, "mass_e8", "is_y", "z", "pos", fragment_bin("m", "z", p.scale).alias("bin"))


def matchable(ions: DataFrame, p: SearchParams) -> DataFrame:
    """Fragments below the last bin."""
    return ions.filter(F.col("bin") < p.top_bin)


def bin_histogram(ions: DataFrame) -> DataFrame:
    """bin, n: occupied bins."""
    return ions.groupBy("bin").agg(F.count("*").alias("n"))


def bin_offsets(ions: DataFrame, width: int = 4096) -> DataFrame:
    """bin, n, first: where a bin's ions begin in bin order (exclusive prefix sum), two-level by ranges of bins."""
    from pyspark.sql import Window

    counts = bin_histogram(ions).withColumn("_range", F.expr(f"bin div {width}"))
    ranges = counts.groupBy("_range").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(ranges, "_range").select("bin", "n", (F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"))


def occupancy(ions: DataFrame) -> DataFrame:
    """Mean and population deviation of ions a bin."""
    return bin_histogram(ions).agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def position_uniqueness(ions: DataFrame, entries: DataFrame) -> DataFrame:
    """len, pos, n_ions, n_bins: distinct bins of singly charged b fragments."""
    b = ions.filter("is_y = 0 and z = 1").join(entries.select("entry_id", "len"), "entry_id")
    return b.groupBy("len", "pos").agg(F.count("*").alias("n_ions"), F.countDistinct("bin").alias("n_bins"))
