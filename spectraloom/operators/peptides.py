"""Proteins to peptides: cleaning, digestion, filters, collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.chem import LETTERS, UNIT
from spectraloom.functions.ordinal import numbered
from spectraloom.functions.peptide import peptide_mass
from spectraloom.params import SearchParams

#: A cut behind K or R unless P follows.
TRYPSIN = "(?<=[KR])(?!P)"


def clean(documents: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, seq: the letters A-Z of a text, upper case; anything else is dropped first."""
    return documents.select(id_col, F.upper(F.regexp_replace(text, "[^A-Za-z]", "")).alias("seq"))


def digest(proteins: DataFrame, id_col: str = "doc_id", enzyme: str = TRYPSIN) -> DataFrame:
    """id, idx (from 0), seq: the non-empty pieces between cuts."""
    pieces = F.filter(F.split("seq", enzyme), lambda p: p != "")
    return proteins.select(id_col, F.posexplode(pieces).alias("idx", "seq"))


def missed_cleavages(proteins: DataFrame, most: int, id_col: str = "doc_id", enzyme: str = TRYPSIN, min_length: int = 1, max_length: int = 1 << 30) -> DataFrame:
    """id, idx, missed, seq: runs of 1 to ``most`` + 1 adjacent pieces within the length bounds."""
    cut = proteins.select(id_col, F.filter(F.split("seq", enzyme), lambda p: p != "").alias("p")).filter(F.size("p") > 0)
    starts = cut.select(id_col, "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("idx"))
    runs = starts.select(id_col, "p", "idx", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.size("p") - 1 - F.col("idx")))).alias("missed"))
    out = runs.select(id_col, "idx", "missed", F.array_join(F.slice("p", F.col("idx") + 1, F.col("missed") + 1), "").alias("seq"))
    return out.filter(F.length("seq").between(min_length, max_length))


def legal(seq: Column | str) -> Column:
    return F.col(seq).rlike(f"^[{LETTERS}]+$") if isinstance(seq, str) else seq.rlike(f"^[{LETTERS}]+$")


def peptides(pieces: DataFrame, p: SearchParams) -> DataFrame:
    """seq, len, mass_e8: distinct legal pieces within the length and mass bounds.

    Length and letters are checked before the shuffle of the distinct, the
    mass behind it, once a peptide.
    """
    found = pieces.select("seq").filter(F.length("seq").between(p.min_length, p.max_length) & legal("seq")).distinct()
    found = found.select("seq", F.length("seq").alias("len"), peptide_mass(F.col("seq")).alias("mass_e8"))
    return found.filter(F.col("mass_e8").between(p.min_mass_e8, p.max_mass_e8))


def entries(found: DataFrame) -> DataFrame:
    """``found`` with entry_id = 1, 2, … by length, mass, sequence; ordered within ranges of mass, not in one task."""
    bucket = F.col("len") * 2000 + F.expr(f"mass_e8 div {5 * UNIT}")
    return numbered(found, bucket, ["mass_e8", "seq"], "entry_id").select("entry_id", "seq", "len", "mass_e8")


def from_proteins(documents: DataFrame, p: SearchParams) -> DataFrame:
    """Entries of a table of texts: clean, digest with the allowed missed cleavages, filter, number."""
    proteins = clean(documents)
    pieces = missed_cleavages(proteins, p.missed_cleavages) if p.missed_cleavages else digest(proteins)
    return entries(peptides(pieces, p))


def collated(found: DataFrame) -> DataFrame:
    """Distinct sequences with a key that sorts I and L side by side (K and L swapped)."""
    return found.select("seq").distinct().select("seq", F.translate("seq", "KL", "LK").alias("collation"))


def by_terminus(found: DataFrame, letter: str) -> DataFrame:
    """Peptides that end with ``letter``."""
    return found.filter(F.right("seq", F.lit(1)) == letter)


def kth_match(lines: DataFrame, order: str, pattern: str, k: int) -> DataFrame:
    """The k-th row, in the order of a column, whose value holds the pattern."""
    return lines.filter(F.col("value").rlike(pattern)).orderBy(order).limit(k).orderBy(F.desc(order)).limit(1)


def sample_per_length(found: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k peptides of each length, by an arithmetic hash of the mass, so that every engine agrees."""
    from pyspark.sql import Window

    key = F.pmod(F.col("mass_e8") * 31 + F.lit(seed), F.lit(1_000_003))
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("len").orderBy(key, "seq")))
    return ranked.filter(F.col("k") <= k).drop("k")
