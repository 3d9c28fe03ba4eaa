import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.functions.expect import gumbel_density, gumbel_expect, gumbel_expect_many, savgol, tail_expect, tail_fit
from spectraloom.operators import expect
from spectraloom.operators.series import gumbel_curve, holt_irregular


def test_savgol_keeps_polynomials():
    x = np.arange(20.0)
    y = 3 + 2 * x - 0.5 * x**2
    assert np.allclose(savgol(y, 7, 2), y)
    assert np.allclose(savgol(np.array([1.0, 2.0]), 5, 2), [1, 2])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 50), min_size=2, max_size=40), st.integers(1, 39))
def test_tail_fit_is_finite_or_nan(counts, top):
    slope, intercept = tail_fit(np.array(counts), max(1, sum(counts)), min(top, len(counts) - 1))
    assert np.isfinite(slope) == np.isfinite(intercept)


def test_gumbel_fit_falls_with_the_score():
    x = np.arange(60)
    counts = np.round(3000 * gumbel_density(x, 18, 4))
    near, far = gumbel_expect(counts, int(counts.sum()), 30), gumbel_expect(counts, int(counts.sum()), 50)
    assert 0 < far < near


def test_window_form_equals_numpy(spark):
    rng = np.random.default_rng(3)
    hist, best, want = [], [], {}
    for i in range(60):
        scores = np.minimum(np.maximum(rng.gumbel(12, 4, rng.integers(2, 300)), 0.6), 70).astype(int)
        bins, n = np.unique(scores, return_counts=True)
        top = int(bins[-1])
        hist += [(i, int(b), int(c)) for b, c in zip(bins, n)]
        best.append((i, top / 10, int(n.sum())))
        dense = np.zeros(top + 2)
        dense[bins] = n
        want[i] = tail_expect(dense, int(n.sum()), top)
    h = spark.createDataFrame(hist, "spectrum_id long, hbin int, n long")
    b = spark.createDataFrame(best, "spectrum_id long, hyperscore double, num_hits long")
    got = {r.spectrum_id: r.expect for r in expect.tail_expect(h, b).collect()}
    assert all(got[i] == pytest.approx(v, rel=1e-6) for i, v in want.items() if np.isfinite(v) and i in got)
    assert len(got) >= 50


def test_curve_and_forecast(spark):
    got = spark.range(1).select(gumbel_curve(0, 5, 2.0, 1.5).alias("c")).first().c
    assert np.allclose(got, gumbel_density(np.arange(6), 2.0, 1.5))
    assert holt_irregular([0, 1, 3], [2.0, 2.0, 2.0]) == pytest.approx(2.0)
    assert spark.range(1).select(F.lit(1)).count() == 1


def plain_descent(counts, hits, top, steps=6000, rate=0.12, stop=1e-3):
    from spectraloom.functions.expect import _gumbel_target

    start, target, mu = _gumbel_target(counts, top)
    x, beta = start + np.arange(len(target)), 4.0
    for _ in range(steps):
        z = np.clip((x - mu) / beta, -50, 50)
        p = np.exp(-(z + np.exp(-z))) / beta
        gap = p - target
        if (gap * gap).sum() < stop:
            break
        slope = 2 * gap * p * beta
        mu, beta = mu - rate * (slope * (1 - np.exp(-z))).sum(), max(0.1, beta - rate * (slope * (z * (1 - np.exp(-z)) - 1)).sum())
    return float(hits * gumbel_density(np.array([top]), mu, beta)[0])


def test_descent_of_many_is_that_of_each():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        counts = np.bincount(np.minimum(np.maximum(rng.gumbel(20 + i, 1 + i / 4, 50 + 40 * i), 1), 400).astype(int))
        counts[rng.integers(0, len(counts), len(counts) // 3)] = 0
        rows.append((np.append(counts, [1, 0]), int(counts.sum()) + 1, len(counts)))
    got = gumbel_expect_many(rows)
    want = [plain_descent(*r) for r in rows]
    assert all(g == pytest.approx(w, rel=1e-6, abs=1e-300) for g, w in zip(got, want, strict=True))


def test_fits_are_dealt_to_all_cores(spark):
    h = spark.createDataFrame([(i, b, 5) for i in range(40) for b in range(3, 9)], "spectrum_id long, hbin int, n long")
    b = spark.createDataFrame([(i, 0.9, 31) for i in range(40)], "spectrum_id long, hyperscore double, num_hits long")
    got = expect.gumbel_expect(h, b).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({r.task for r in got}) > 4
