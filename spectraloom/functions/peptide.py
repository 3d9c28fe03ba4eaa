"""Column expressions over peptides and scores; all of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spectraloom.chem import INVALID_E8, MASS_E8, PROTON_E8, UNIT, WATER_E8

#: log10(n!) is looked up below this and summed above.
_LOOKUP = 256


def residue_masses(seq: Column) -> Column:
    """array<bigint> of the residues' masses; a letter that is no residue has the invalid mass."""
    table = F.array(*(F.lit(MASS_E8.get(chr(65 + i), INVALID_E8)).cast("long") for i in range(26)))
    index = lambda c: F.ascii(c) - 64
    return F.transform(F.split(seq, ""), lambda c: F.when(index(c).between(1, 26), F.element_at(table, index(c))).otherwise(F.lit(INVALID_E8).cast("long")))


def total(masses: Column) -> Column:
    return F.aggregate(masses, F.lit(0).cast("long"), lambda a, x: a + x)


def peptide_mass(seq: Column) -> Column:
    """Neutral mass in 1e-8 Da: water and the residues."""
    return total(residue_masses(seq)) + F.lit(WATER_E8).cast("long")


def prefix_sums(masses: Column) -> Column:
    """array of len + 1 sums: of no residue, the first, the first two and so on."""
    return F.aggregate(masses, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def fragment_bin(mass_e8: str, charge: str, scale: int) -> Column:
    """Bin of a neutral fragment mass at a charge; both are SQL expressions."""
    return F.expr(f"cast((({mass_e8} + {charge} * {PROTON_E8}L) * {scale}L) div ({charge} * {UNIT}L) as int)")


def log10_factorial(n: Column) -> Column:
    sums, table = 0.0, [0.0]
    for i in range(1, _LOOKUP):
        sums += math.log10(i)
        table.append(sums)
    known = F.element_at(F.array(*map(F.lit, table)), (n + 1).cast("int"))
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")), F.lit(0.0), lambda a, x: a + F.log10(x))
    return F.when(n < _LOOKUP, known).otherwise(summed)


def hyperscore(b: Column, y: Column, b_int: Column, y_int: Column) -> Column:
    """log10 of both factorials and both summed intensities, less 4, at most 79."""
    value = log10_factorial(b) + log10_factorial(y) + F.log10(b_int + F.lit(1)) + F.log10(y_int + F.lit(1)) - F.lit(4.0)
    return F.least(value, F.lit(79.0))


def register(spark: SparkSession) -> None:
    """SQL functions peptide_mass(seq), log10_factorial(n), hyperscore(b, y, b_int, y_int), fragment_bin(mass_e8, z, scale) and expect_tailfit(bins, counts, hits, top_bin)."""
    letters = ", ".join(str(MASS_E8.get(chr(65 + i), INVALID_E8)) + "L" for i in range(26))
    mass = f"aggregate(split(seq, ''), {WATER_E8}L, (a, c) -> a + CASE WHEN ascii(c) BETWEEN 65 AND 90 THEN element_at(array({letters}), ascii(c) - 64) ELSE {INVALID_E8}L END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION peptide_mass(seq STRING) RETURNS BIGINT RETURN {mass}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION log10_factorial(n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n < 2 THEN 0D ELSE aggregate(sequence(1L, greatest(n, 1L)), 0D, (a, x) -> a + log10(x)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hyperscore(b BIGINT, y BIGINT, b_int BIGINT, y_int BIGINT) RETURNS DOUBLE RETURN least(79D, log10_factorial(b) + log10_factorial(y) + log10(1 + b_int) + log10(1 + y_int) - 4D)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fragment_bin(mass_e8 BIGINT, z INT, scale INT) RETURNS BIGINT RETURN ((mass_e8 + z * {PROTON_E8}L) * scale) div (z * {UNIT}L)")
    from spectraloom.functions.expect import expect_tailfit_udf

    spark.udf.register("expect_tailfit", expect_tailfit_udf)
