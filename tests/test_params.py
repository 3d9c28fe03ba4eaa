import pytest
from hypothesis import given
from hypothesis import strategies as st

from spectraloom.chem import MASS_E8, to_e8
from spectraloom.operators.distribute import sizes
from spectraloom.operators.mods import count_of, placements
from spectraloom.params import ModSpec, Policy, SearchParams, parse_mods


def test_defaults_and_derived():
    p = SearchParams()
    assert (p.scale, p.df_bins, p.dm_e8, p.base, p.min_intensity, p.top_bin) == (100, 2, 1_000_000_000, 100_000, 1000, 499_999)
    assert SearchParams(df=0.29).df_bins == 29
    assert not p.open_search and SearchParams(dm=-1).open_search
    assert SearchParams(resolution=9).resolution == 0.01 and SearchParams(nmods=99).nmods == 7
    assert SearchParams(min_length=9, max_length=7).min_length == 7
    with pytest.raises(ValueError):
        SearchParams(min_mass=9, max_mass=7)


def test_file_and_changes():
    p = SearchParams.from_lines(["# none", "dm = 500 # wide", "min_hits=2", "policy = zigzag", "gumbel_fit=yes", "mods = M:15.99:2"])
    assert (p.dm, p.min_hits, p.policy, p.gumbel_fit, p.mods[0].mass_e8) == (500.0, 2, Policy.ZIGZAG, True, to_e8("15.99"))
    assert set(p.changed(SearchParams())) == {"dm", "min_hits", "policy", "gumbel_fit", "mods"}
    with pytest.raises(ValueError):
        SearchParams.from_lines(["colour=red"])


def test_mod_specs():
    assert ModSpec.parse("M:-17.026:1").mass_e8 == to_e8("-17.026")
    assert ModSpec.parse("M:15.999:1", scale=100).mass_e8 == to_e8("15.99")
    assert parse_mods("none") == ()
    for bad in ("M:1", "B:1:1", "M:1:0", "MM:1:1"):
        with pytest.raises(ValueError):
            ModSpec.parse(bad)
    with pytest.raises(ValueError):
        parse_mods("MS:1:1 ST:2:1")


@given(st.text("MSTAK", max_size=9), st.integers(1, 3), st.integers(1, 3), st.integers(1, 4))
def test_count_is_number_of_placements(seq, a, b, limit):
    mods = (ModSpec("M", 1, a), ModSpec("ST", 2, b))
    found = list(placements(seq, mods, limit))
    assert len(set(found)) == len(found) == count_of([seq.count("M"), seq.count("S") + seq.count("T")], [a, b], limit)
    assert all(len(x) <= limit for x in found)


@given(st.integers(1, 9), st.integers(0, 99))
def test_sizes(parts, total):
    got = sizes(parts, total)
    assert sum(got) == total and max(got) - min(got) <= 1 and got == sorted(got, reverse=True)


def test_cysteine_has_static_mass():
    assert MASS_E8["C"] == to_e8("103.00919") + to_e8("57.021464")
