"""Line dedup: no text is sorted for a join, and lines that nothing is like go early."""

import odd

from spectraloom.llm import lines

LONG = "one two three four five six seven eight nine ten eleven twelve"


def rows_of(texts):
    rest = odd.documents()[0][2:]
    return [(i, t, *rest) for i, t in enumerate(texts)]


def test_lines_without_a_copy_or_a_link_are_not_kept(spark, monkeypatch):
    texts = [f"a line of its own, number {i}\nanother of {i} alone" for i in range(20)] + ["short copy", "short copy", LONG, LONG.replace("seven", "7")]
    kept, store = [], lines.stored

    def stored(df):
        out = store(df)
        if df.columns == ["h", "first", "n", "component"]:
            kept.append(out.count())
        return out

    monkeypatch.setattr(lines, "stored", stored)
    got = {r.doc_id: r.n_removed for r in lines.deduplicate(odd.frame(spark, rows_of(texts))).collect()}
    assert kept == [3]  # the copied line once, and the two that are linked
    assert {i for i, n in got.items() if n} == {21, 23}


def test_texts_meet_their_lines_without_a_sort_by_document(spark):
    docs = odd.frame(spark, rows_of([LONG, LONG + "\nmore", None]) + rows_of([LONG]))
    places = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0)], "h long, id long, line int").join(docs.selectExpr("doc_id id", "xxhash64(text) cls").distinct(), "id")
    found = lines._texts(docs, lines.stored(places.select("h", "id", "cls", "line")))
    got = sorted((r.h, len(r.words)) for r in found.collect())
    assert got == [(1, 1), (2, 12), (3, 12)]  # the document that is there twice gives its line once
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_only_texts_that_lose_lines_are_cut(spark):
    """Texts travel whole to their removed lines; one that loses none comes back as it was."""
    texts = ["kept line\nsecond", "kept line\n\nthird", "\n\n", "", None, "ends with a feed\n"]
    found = lines.deduplicate(odd.frame(spark, rows_of(texts)))
    split = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "split(text" in x]
    assert len(split) == 1 and "Join" not in "".join(found._jdf.queryExecution().optimizedPlan().toString().split("split(text")[0])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found.collect()}
    assert got == {0: (texts[0], 2, 0), 1: ("\nthird", 3, 1), 2: ("\n\n", 3, 0), 3: ("", 1, 0), 4: (None, 0, 0), 5: (texts[5], 2, 0)}
