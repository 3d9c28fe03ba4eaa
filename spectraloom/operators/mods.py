"""Variable modifications: counts, placements and variants of peptides."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spectraloom.params import ModSpec, SearchParams


def placements(seq: str, mods: tuple[ModSpec, ...], limit: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Non-empty tuples of (position from 1, modification), at most each spec's number and ``limit`` in all."""
    sites = [[i + 1 for i, c in enumerate(seq) if c in m.residues] for m in mods]

    def extend(k: int, left: int) -> Iterator[tuple[tuple[int, int], ...]]:
        if k == len(mods):
            yield ()
            return
        for n in range(min(mods[k].max_per_peptide, left, len(sites[k])) + 1):
            for chosen in combinations(sites[k], n):
                for rest in extend(k + 1, left - n):
                    yield tuple((pos, k) for pos in chosen) + rest

    for found in extend(0, limit):
        if found:
            yield tuple(sorted(found))


def count_of(sites: list[int], most: list[int], limit: int) -> int:
    """Placements by numbers of sites: coefficients of the product of truncated binomials."""
    ways = [1] + [0] * limit
    for n, m in zip(sites, most, strict=True):
        ways = [sum(ways[t - k] * comb(n, k) for k in range(min(m, t, n) + 1)) for t in range(limit + 1)]
    return sum(ways) - 1


def variant_count(seq: Column, p: SearchParams) -> Column:
    """Number of variants of a peptide, the unmodified one left out."""
    mods, limit = p.mods, p.nmods

    @pandas_udf("long")
    def counted(s: pd.Series) -> pd.Series:
        return s.map(lambda q: count_of([sum(c in m.residues for c in q) for m in mods], [m.max_per_peptide for m in mods], limit))

    return counted(seq) if mods else F.lit(0).cast("long")


def variants(peptides: DataFrame, p: SearchParams, most_per_peptide: int | None = None) -> DataFrame:
    """seq, len, mass_e8 (with modifications), mods array<struct<pos, mod, mass_e8>> of all variants in the mass bounds.

    Placements are enumerated by an Arrow-fed map over the peptides, one at a
    time. With ``most_per_peptide`` a peptide that has more is an error, found
    by counting before anything is enumerated.
    """
    mods, limit = p.mods, p.nmods

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for seq, length, mass in frame.itertuples(index=False):
                if most_per_peptide is not None:
                    n = count_of([sum(c in m.residues for c in seq) for m in mods], [m.max_per_peptide for m in mods], limit)
                    if n > most_per_peptide:
                        raise ValueError(f"{seq} has {n} variants")
                for found in placements(seq, mods, limit):
                    rows.append((seq, length, mass + sum(mods[k].mass_e8 for _, k in found), [{"pos": i, "mod": k, "mass_e8": mods[k].mass_e8} for i, k in found]))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=["seq", "len", "mass_e8", "mods"])
                        rows = []
            yield pd.DataFrame(rows, columns=["seq", "len", "mass_e8", "mods"])

    schema = "seq string, len int, mass_e8 long, mods array<struct<pos: int, mod: int, mass_e8: long>>"
    if not mods:
        return peptides.sparkSession.createDataFrame([], schema)
    made = peptides.select("seq", "len", "mass_e8").mapInPandas(work, schema)
    return made.filter(F.col("mass_e8").between(p.min_mass_e8, p.max_mass_e8))


def with_variants(peptides: DataFrame, p: SearchParams) -> DataFrame:
    """Peptides (mods empty) and their variants in one table."""
    plain = peptides.select("seq", "len", "mass_e8", F.array().cast("array<struct<pos: int, mod: int, mass_e8: bigint>>").alias("mods"))
    return plain.unionByName(variants(peptides, p)) if p.mods else plain


def offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """``counts`` with first: the rows of all smaller keys (exclusive prefix sum), by the string ``key``.

    Sums of ranges of keys (their first three characters) meet in one task, the
    keys of a range in one each.
    """
    rows = counts.withColumn("_range", F.substring(F.coalesce(key, F.lit("")), 1, 3))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").agg(F.sum(n).alias("_sum"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(n).over(earlier(Window.partitionBy("_range").orderBy(key))), F.lit(0))
    return rows.join(ranges, "_range").withColumn("first", F.col("_before") + inside).drop("_range", "_before")


def mod_info(mods: str) -> Column:
    """Text form of placements: position and mass, e.g. ``3:+15.990000``."""
    return F.array_join(F.transform(mods, lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), F.format_string("%+.6f", x["mass_e8"] / 1e8))), ";")
