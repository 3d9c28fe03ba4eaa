"""Word classes: no neighbour is left out of the counts."""

from spectraloom.llm import brown


def test_every_neighbour_is_counted(spark, monkeypatch):
    texts = ["a b c d e f", "a b g h a", "c i j k a b", "a"]
    train = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    seen, exchange = [], brown.exchange
    monkeypatch.setattr(brown, "exchange", lambda beside, *k: (seen.append(beside), exchange(beside, *k))[1])
    brown.fit(train, brown.Settings(clustered=64, contexts=2, classes=3))
    counts = sorted((sum(t.split().count(w) for t in texts) for w in "abcdefghijk"), reverse=True)
    assert [int(n) for n in seen[0].sum(1)] == [2 * n for n in counts]
