"""The closed search by mass shards gives the rows of the join on bin and mass."""

import pytest
from pyspark.sql import functions as F

from spectraloom import queries
from spectraloom.operators import cards, match, score, spectra
from spectraloom.operators import ions as ion
from spectraloom.operators.peptides import from_proteins
from spectraloom.params import SearchParams

KEY = ("spectrum_id", "entry_id", "b_cnt", "y_cnt", "b_int", "y_int")


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 4 = 0")
    entries = from_proteins(docs, SearchParams()).cache()
    ions = ion.matchable(ion.fragments(entries, SearchParams()), SearchParams())
    heads, peaks = spectra.from_fragments(ions)
    return heads, spectra.pick(peaks, SearchParams()).cache(), entries, ions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("dm", "charge", "shard"), [(10.0, False, 1 << 15), (10.0, True, 7), (0.3, False, 1 << 15), (120.0, False, 50)])
def test_cards_of_shards_are_those_of_the_join(made, dm, charge, shard):
    heads, peaks, entries, ions = made
    p = SearchParams(dm=dm, match_charge=charge, min_shared=1)
    want = rows(score.scorecard(match.fragment_join(heads, peaks, ions, p)).select(*KEY))
    assert want and rows(cards.closed_cards(heads, peaks, ions, entries, p, shard)) == want
    parts = [ions.filter(F.col("z") == k) for k in (1, 2, 3)]
    assert rows(cards.closed_cards(heads, peaks, parts, entries, p, shard)) == want


@pytest.mark.parametrize(("best", "shard"), [(1, 1 << 15), (3, 9)])
def test_histograms_and_best_of_shards(made, best, shard):
    heads, peaks, entries, ions = made
    p = SearchParams()
    found = score.candidates(score.scorecard(match.fragment_join(heads, peaks, ions, p)), p)
    got = cards.closed_search(heads, peaks, ions, entries, p, best, shard)
    assert rows(cards.histogram_of(got)) == rows(score.histogram(found))
    near = score.candidates(cards.candidates_of(got), p)
    key = ("spectrum_id", "rank", "entry_id", "hyperscore")
    assert rows(score.top_k(near, heads, entries, best).select(*key)) == rows(score.top_k(found, heads, entries, best).select(*key))
    assert rows(score.top_one(near, heads, entries, score.histogram(found)).select("spectrum_id", "entry_id", "num_hits")) == rows(score.top_one(found, heads, entries).select("spectrum_id", "entry_id", "num_hits"))


@pytest.mark.parametrize("name", ["fragment_bin_join", "charge_gated_join", "scorecard", "candidate_filter", "partial_merge"])
def test_no_match_is_shuffled(spark, name):
    """The rows come out of the shards; nothing is joined or summed behind them."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Aggregate" not in above and "Join" not in above


@pytest.mark.parametrize(("dm", "charge", "shard"), [(10.0, False, 1 << 15), (10.0, True, 7), (0.3, False, 1 << 15), (120.0, False, 50)])
def test_ladders_give_the_rows_of_their_ions(made, dm, charge, shard):
    heads, peaks, entries, ions = made
    p = SearchParams(dm=dm, match_charge=charge, min_shared=1)
    want = rows(score.scorecard(match.fragment_join(heads, peaks, ions, p)).select(*KEY))
    ladders = ion.ladders(entries, p)
    assert want and rows(cards.closed_cards(heads, peaks, ladders, entries, p, shard)) == want
    assert rows(cards.closed_cards(heads, peaks, [ladders.filter(F.col("entry_id") % 3 == k) for k in range(3)], entries, p, shard)) == want


@pytest.mark.parametrize("name", ["fragment_bin_join", "hyperscore", "scorecard", "candidate_filter", "partial_merge"])
def test_an_entry_is_shuffled_as_one_row(spark, name):
    """Of all entries no ion is shuffled: the only fragments in the plan are those that spectra are made of."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(1, 2, 3))") + plan.count("Generate explode([1,2,3])") == 1
