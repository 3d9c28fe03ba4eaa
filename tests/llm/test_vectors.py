"""Exact and approximate search against brute force."""

import numpy as np
import pytest

from spectraloom.llm import hilbert, kdtree
from spectraloom.llm.kdtree import KDTree

SCHEMA = "vec_id long, embedding array<float>, label int, g string, query string, id int, bound string"


def table(spark, n=400, d=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=d)], 0, "a", "b", 1, "c") for i in range(n)]
    for i in range(50, 90):
        rows[i] = (i, rows[50][1], *rows[i][2:])
    bad = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [1.0] * (d + 1)]
    rows += [(1000 + 20 * i, v, 0, "a", "b", 1, "c") for i, v in enumerate(bad)] + [(None, [1.0] * d, 0, "a", "b", 1, "c"), rows[3]]
    good = {r[0]: r[1] for r in rows if r[0] is not None and r[1] and len(r[1]) == d and all(x is not None and np.isfinite(x) for x in r[1])}
    return spark.createDataFrame(rows, SCHEMA).repartition(3), good


@pytest.mark.parametrize("settings", [kdtree.Settings(), kdtree.Settings(shard_rows=37, leaf_rows=4)])
def test_top_k(spark, settings):
    df, good = table(spark)
    got: dict = {}
    for r in kdtree.search(df, 20, settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    z = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in good.items()}
    assert set(got) == {i for i in z if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((i, int(v @ z[q])) for i, v in z.items() if i != q), key=lambda x: (-x[1], x[0]))[:20]
        assert found == want


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-40, 40, (3000, 3)).astype(float)
    tree = KDTree(np.arange(3000), x, 16)
    for _ in range(10):
        q = rng.integers(-40, 40, 3).astype(float)
        want = sorted(((int(s), i) for i, s in enumerate(x @ q)), key=lambda v: (-v[0], v[1]))[:5]
        assert tree.top(q, -1, 5, -np.inf) == want
        assert tree.top(q, -1, 5, want[-1][0]) == want
        assert tree.top(q, -1, 5, want[0][0] + 1) == []


def test_few_candidates_and_empty(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for f in (kdtree.search, hilbert.search):
        assert f(one, 20).count() == 0 and f(none, 20).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hilbert.search(two, 20).collect()] == [(0, 1, 1, float(np.sqrt(8)))]


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3)])
def test_hilbert_curve_is_a_path(dims, bits):
    cells = np.array(list(np.ndindex(*[1 << bits] * dims)), np.uint64)
    h = hilbert.hilbert_index(cells, bits)
    assert sorted(h.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(h)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("settings", [hilbert.Settings(), hilbert.Settings(range_rows=5, ranges=10)])
def test_neighbours(spark, settings):
    df, good = table(spark, n=1500, d=12)
    good = {i: v for i, v in good.items() if any(v)}
    got: dict = {}
    for r in hilbert.search(df, 100, settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 100 == 0}
    hits = []
    for q, found in got.items():
        score = {i: float(np.sqrt(((np.array(v) - np.array(good[q])) ** 2).sum())) for i, v in good.items() if i != q}
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and len(found) == 10
        want = sorted(score, key=lambda i: (score[i], i))[:10]
        hits.append(len({i for i, _ in found} & set(want)) / 10)
    assert np.mean(hits) >= 0.9
