"""The closed search plans in steps: no plan holds another's, and the driver gives memory back behind each."""

import pytest

from spectraloom import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "tables"), [("tailfit_params", 2), ("survival_function", 2), ("expect_tailfit", 2), ("score_histogram", 1), ("candidate_filter", 3), ("partial_merge", 6), ("report_roundtrip", 1)])
def test_plans_read_stored_tables_only(spark, monkeypatch, name, tables):
    said, ease = [], queries.ease
    monkeypatch.setattr(queries, "ease", lambda s: said.append(ease(s)))
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(said) >= 3 and all(x == "" or "rim native heap" in x for x in said)
    assert plan.count("Relation [") <= tables, plan


def test_peptides_are_digested_once(spark, monkeypatch):
    plans, stored = [], queries._stored
    monkeypatch.setattr(queries, "_stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    queries._self(spark, DATA)
    assert sum(p.count("posexplode") + p.count("Generate explode(filter(split") for p in plans) == 1, plans


def test_search_stores_what_its_fit_reads_twice(spark, monkeypatch):
    """Peptides, entries, heads and rows of the shards, then histogram and best matches."""
    kept, stored = [], queries._stored
    monkeypatch.setattr(queries, "_stored", lambda df: kept.append(df.columns) or stored(df))
    queries.report_roundtrip(spark, DATA)
    assert kept[4:] == [["spectrum_id", "hbin", "n"], kept[-1]] and "num_hits" in kept[-1]
