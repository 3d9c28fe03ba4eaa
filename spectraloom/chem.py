"""Masses as integers of 1e-8 Da, so that sums are exact."""

UNIT = 100_000_000

#: Residue masses in Da, water, proton and the static addition to cysteine.
RESIDUES = {
    "A": "71.03712", "C": "103.00919", "D": "115.030", "E": "129.0426", "F": "147.068", "G": "57.02146", "H": "137.060",
    "I": "113.084", "K": "128.094", "L": "113.084", "M": "131.0405", "N": "114.043", "P": "97.0527", "Q": "128.05858",
    "R": "156.1012", "S": "87.032", "T": "101.0476", "V": "99.06841", "W": "186.0793", "Y": "163.0633",
}
WATER, PROTON, STATIC = "18.015", "1.00727647", {"C": "57.021464"}
INVALID = "-20000"


def to_e8(da: str | float) -> int:
    """A mass in Da as an integer, decimal digits kept exactly."""
    from decimal import Decimal

    return int((Decimal(str(da)) * UNIT).to_integral_value())


WATER_E8, PROTON_E8, INVALID_E8 = to_e8(WATER), to_e8(PROTON), to_e8(INVALID)
MASS_E8 = {a: to_e8(m) + to_e8(STATIC.get(a, "0")) for a, m in RESIDUES.items()}
LETTERS = "".join(RESIDUES)
