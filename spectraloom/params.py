"""Search parameters and modification specs."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from decimal import Decimal
from enum import Enum

from spectraloom.chem import LETTERS, to_e8


class Policy(Enum):
    """How entries are dealt to partitions."""

    CYCLIC = "cyclic"
    CHUNK = "chunk"
    ZIGZAG = "zigzag"


@dataclass(frozen=True)
class ModSpec:
    """Residues that may carry a modification, its mass and how many a peptide may have."""

    residues: str
    mass_e8: int
    max_per_peptide: int

    @classmethod
    def parse(cls, text: str, scale: int | None = None) -> ModSpec:
        """``AA:mass:count``, e.g. ``M:15.99:2``; with ``scale`` the mass is cut to 1 / scale Da."""
        parts = [p.strip() for p in text.split(":")]
        if len(parts) != 3:
            raise ValueError(f"expected AA:mass:count, got {text!r}")
        residues, mass, count = parts[0].upper(), Decimal(parts[1]), int(parts[2])
        if not residues or set(residues) - set(LETTERS) or len(set(residues)) < len(residues):
            raise ValueError(f"bad residues in {text!r}")
        if count < 1:
            raise ValueError(f"count below 1 in {text!r}")
        if scale:
            mass = Decimal(int(mass * scale)) / scale
        return cls(residues, to_e8(mass), count)


def parse_mods(text: str, scale: int | None = None) -> tuple[ModSpec, ...]:
    """A comma- or blank-separated list of specs; a residue may be in one of them only."""
    if text.strip().lower() in ("", "none"):
        return ()
    specs = tuple(ModSpec.parse(t, scale) for t in text.replace(",", " ").split())
    letters = "".join(s.residues for s in specs)
    if len(set(letters)) < len(letters):
        raise ValueError("a residue is in several modifications")
    return specs


@dataclass(frozen=True)
class SearchParams:
    """Parameters of a search. dm in Da (negative: unbounded), df in Da, intensities relative to base_intensity."""

    nmods: int = 3
    min_length: int = 6
    max_length: int = 40
    max_charge: int = 3
    min_mass: float = 500.0
    max_mass: float = 5000.0
    min_shared: int = 4
    top: int = 1
    min_hits: int = 4
    base_intensity: int = 1000
    cutoff_ratio: float = 0.01
    resolution: float = 0.01
    dm: float = 10.0
    df: float = 0.02
    expect_max: float = 20.0
    top_peaks: int = 100
    missed_cleavages: int = 0
    policy: Policy = Policy.CYCLIC
    mods: tuple[ModSpec, ...] = field(default_factory=tuple)
    reindex: bool = False
    nocache: bool = False
    gumbel_fit: bool = False
    match_charge: bool = False
    quantise_mod_mass: bool = False
    precursor_is_mh: bool = False

    def __post_init__(self):
        if not 0 < self.resolution <= 5:
            object.__setattr__(self, "resolution", 0.01)
        object.__setattr__(self, "nmods", min(max(self.nmods, 1), 7))
        if self.min_length > self.max_length:
            a, z = self.max_length, self.min_length
            object.__setattr__(self, "min_length", a)
            object.__setattr__(self, "max_length", z)
        if self.min_mass > self.max_mass or self.max_charge < 1 or self.min_shared < 1:
            raise ValueError("mass bounds reversed, or a charge or shared-peak bound below 1")

    @property
    def scale(self) -> int:
        """Bins a Da."""
        return int(Decimal(1) / Decimal(str(self.resolution)))

    @property
    def df_bins(self) -> int:
        return int(Decimal(str(self.df)) * self.scale)

    @property
    def dm_e8(self) -> int:
        return to_e8(self.dm if self.dm >= 0 else 1_048_576)

    @property
    def open_search(self) -> bool:
        return self.dm < 0 or self.dm > 50

    @property
    def min_mass_e8(self) -> int:
        return to_e8(self.min_mass)

    @property
    def max_mass_e8(self) -> int:
        return to_e8(self.max_mass)

    @property
    def top_bin(self) -> int:
        """Bins from here on never match."""
        return int(Decimal(str(self.max_mass)) * self.scale) - 1

    @property
    def base(self) -> int:
        return self.base_intensity * 100

    @property
    def min_intensity(self) -> int:
        return int(Decimal(self.base) * Decimal(str(self.cutoff_ratio)) + Decimal("0.5"))

    @classmethod
    def from_lines(cls, lines) -> SearchParams:
        """``key=value`` lines, ``#`` starts a comment; unknown keys are an error."""
        kinds, found = {f.name: f.default for f in fields(cls)}, {}
        for line in lines:
            line = line.split("#")[0].strip()
            if not line:
                continue
            key, _, value = (x.strip() for x in line.partition("="))
            if key not in kinds:
                raise ValueError(f"unknown parameter {key!r}")
            if key == "mods":
                found[key] = parse_mods(value)
            elif key == "policy":
                found[key] = Policy(value.lower())
            elif isinstance(kinds[key], bool):
                found[key] = value.lower() in ("1", "true", "yes", "on")
            else:
                found[key] = type(kinds[key])(value)
        return cls(**found)

    @classmethod
    def from_file(cls, path: str) -> SearchParams:
        with open(path) as lines:
            return cls.from_lines(lines)

    def changed(self, other: SearchParams) -> dict[str, tuple]:
        """Settings that differ: name to (ours, theirs)."""
        return {f.name: (a, b) for f in fields(self) if (a := getattr(self, f.name)) != (b := getattr(other, f.name))}

    def with_(self, **changes) -> SearchParams:
        return replace(self, **changes)
