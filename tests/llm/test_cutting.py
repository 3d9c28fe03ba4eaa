"""op4 cuts the spans of many texts at once, as if it took them one by one, and sorts no text to find them."""

import random

import pyarrow as pa

from spectraloom.llm import suffixes
from spectraloom.llm.common import text_buffer


def one_by_one(texts, cuts):
    spans, kept = [], []
    for text, own in zip(texts, cuts, strict=True):
        data, gone = (text or "").encode(), set()
        for c in own or ():
            gone |= set(range(c["start"], c["end"]))
        edges = [k for k in sorted(gone | {g + 1 for g in gone}) if (k in gone) != (k - 1 in gone)]
        spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        kept.append(bytes(b for k, b in enumerate(data) if k not in gone))
    return spans, kept


def test_spans_of_neighbouring_texts_stay_apart():
    rng, kind = random.Random(1), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for _ in range(60):
        texts, cuts = [], []
        for _ in range(rng.randint(0, 9)):
            texts.append(rng.choice([None, "", "x" * rng.randint(1, 200), "äö" * rng.randint(1, 50)]))
            n = len((texts[-1] or "").encode())
            places = [sorted((rng.choice([0, n, rng.randint(0, n)]), rng.randint(0, n))) for _ in range(rng.randint(0, 6))]
            cuts.append(rng.choice([None, [{"start": x, "end": y} for x, y in places if x < y]]))
        skip = min(len(texts), rng.randint(0, 2))
        spans, kept = suffixes._without(*text_buffer(pa.array(texts, pa.string()).slice(skip)), pa.array(cuts, kind).slice(skip))
        assert (spans.to_pylist(), kept.to_pylist()) == one_by_one(texts[skip:], cuts[skip:])


def test_no_text_is_sorted(spark):
    text = "one passage of well over fifty bytes that two texts of this table have in common "
    docs = spark.createDataFrame([(1, "a " + text + "b"), (2, "c " + text + "d"), (3, None)], "doc_id long, text string")
    found = suffixes.remove(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.doc_id: r.kept.decode() for r in found.collect()} == {1: "a " + text + "b", 2: "cd", 3: ""}
