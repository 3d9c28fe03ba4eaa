"""Line dedup: what is costly is computed once."""

import random

import odd

from spectraloom.llm import lines


def test_edit_distance_is_computed_once_a_pair(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 4)], "a long, b long")
    texts = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghiX"), (3, "abcdefghYZ"), (4, "")], "h long, words string")
    got = lines.verified(pairs, texts, lines.Settings())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1
    assert {tuple(r) for r in got.collect()} == {(1, 2), (4, 4)}


def test_keys_are_shuffled_once(spark, monkeypatch):
    rest, store, plans = odd.documents()[0][2:], lines.stored, []

    def stored(df):
        if df.columns == ["key", "h", "n"]:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(lines, "stored", stored)
    text = "one two three four five six seven eight nine ten eleven twelve"
    got = lines.deduplicate(odd.frame(spark, [(i, t, *rest) for i, t in enumerate([text, text.replace("two", "2"), "a line of nine words that none other is like"])])).collect()
    assert {r.doc_id for r in got if r.n_removed} == {1}
    (final,) = [p.split("== Initial Plan ==")[0] for p in plans]
    assert "ReusedExchange" in final and final.count("Generate explode") == 1


def test_lines_of_other_words_need_no_edit_distance(spark):
    """The bags of words change no verdict, and come before the edit distance."""
    rng, s = random.Random(4), lines.Settings()
    pool = [f"w{i}" for i in range(60)]
    raw = [[rng.choice(pool) for _ in range(40)] for _ in range(6)]
    for base in list(raw):
        for edits in (1, 3, 4, 5, 8, 20):
            copy = list(base)
            for at in sorted(rng.sample(range(40), edits), reverse=True):
                copy[at : at + 1] = rng.choice([[], ["new"], [rng.choice(pool)], [copy[at], "more"]])
            raw.append(copy)
    docs = odd.frame(spark, [(i, " ".join(x), *odd.documents()[0][2:]) for i, x in enumerate(raw)])
    texts = lines.stored(lines._texts(docs, docs.selectExpr("doc_id h", "doc_id id", "xxhash64(text) cls", "0 line")))
    pairs = texts.select(texts.h.alias("a")).crossJoin(texts.select(texts.h.alias("b"))).filter("a < b")
    got = lines.verified(pairs, texts, s)
    found = {tuple(r) for r in got.collect()}
    assert found == {tuple(r) for r in lines.verified(pairs, texts.drop("bag"), s).collect()} and 15 < len(found) < 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("array_except(") < plan.find("levenshtein(")
