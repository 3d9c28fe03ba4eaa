import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.llm.common import components, shingles, steps, text_buffer, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\t\n\x0b\x1c日😀", max_size=30)), max_size=8))
def test_words_of_many_texts(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    h, at = word_hashes(raw, offsets)
    known = {}
    for i, t in enumerate(texts):
        words = WORD.findall(low(t or ""))
        assert at[i + 1] - at[i] == len(words)
        for w, x in zip(words, h[at[i] : at[i + 1]], strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(map(int, known.values()))) == len(known)


def test_words_of_sliced_columns():
    column = pa.array(["x y", None, "z", "x"], pa.string())
    raw, offsets = text_buffer(column.slice(1))
    h, at = word_hashes(raw, offsets)
    assert list(at) == [0, 0, 1, 2]


def test_steps_cover_all_rows():
    offsets = np.array([0, 5, 5, 30, 31])
    assert list(steps(offsets, 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(steps(np.array([0]), 10)) == []


def test_shingles():
    w = np.arange(1, 9).astype(np.uint64)
    assert len(shingles(w, 5)) == 4 and len(shingles(w[:3], 5)) == 1 and len(shingles(w[:0], 5)) == 0
    assert len(shingles(np.ones(9, np.uint64), 5)) == 1
    assert not set(shingles(w[:3], 5)) & set(shingles(w[:4], 5))


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(find(x) == got.get(x, x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
