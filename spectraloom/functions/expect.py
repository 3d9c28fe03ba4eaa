"""Expect values from the tail of a spectrum's score histogram, and from a Gumbel fit.

Plain numpy on one histogram; ``spectraloom.operators.expect`` has the same tail
fit as window functions over all spectra.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _span(counts: np.ndarray, top: int) -> tuple[int, int]:
    """First and last occupied bin below ``top``."""
    on = np.flatnonzero(counts[:top])
    end = int(on[-1]) if len(on) else top - 1
    on = np.flatnonzero(counts[: end + 1])
    start = int(on[0]) if len(on) else 0
    return start, end + 1 if start == end else end


def tail_fit(counts: np.ndarray, hits: int, top: int) -> tuple[float, float]:
    """Slope and intercept of log10 of the survival function over its middle part; NaN without a tail."""
    if top <= 0 or hits <= 0:
        return float("nan"), float("nan")
    counts = np.asarray(counts, float)
    start, end = _span(counts, top)
    padded = np.concatenate([counts, np.zeros(max(0, end + 1 - len(counts)))])
    s = 1 - np.cumsum(padded[start : end + 1]) / hits
    s[s > 1] = 0.999
    ok = np.flatnonzero(s >= 1e-4)
    floor = s[ok[-1] if len(ok) else len(s) - 1]
    s[s <= 0] = floor
    with np.errstate(all="ignore"):
        log = np.log10(s)
    height, n = log[-1] - log[0], len(log)
    if n > 3:
        below = np.flatnonzero(log <= log[0] + 0.22 * height)
        above = np.flatnonzero(log >= log[0] + 0.87 * height)
        first = (int(below[0]) if len(below) else 0) - 1
        last = int(above[-1]) if len(above) else n - 1
        if first >= last:
            first = last - 1
    elif n == 3:
        below = np.flatnonzero(log <= log[0] + 0.22 * height)
        first, last = (int(below[0]) if len(below) else 0) - 1, 2
    else:
        first, last = 0, n - 1
    first = max(first, 0)
    x, y = np.arange(start + first, start + last + 1, dtype=float), log[first : last + 1]
    if len(x) == 1:
        return 0.0, float(y[0])
    dx = x - x.mean()
    slope = float((dx * (y - y.mean())).sum() / (dx * dx).sum())
    return slope, float(y.mean() - slope * x.mean())


def tail_expect(counts: np.ndarray, hits: int, top: int) -> float:
    slope, intercept = tail_fit(counts, hits, top)
    return float(hits * 10 ** (slope * top + intercept)) if np.isfinite(slope) else float("nan")


def savgol(values: np.ndarray, width: int, degree: int) -> np.ndarray:
    """Savitzky–Golay smoothing with odd ``width``; near the ends the window is one-sided, of the same width."""
    values, n = np.asarray(values, float), len(values)
    width = min(width, n if n % 2 else n - 1)
    if width < 3 or degree < 1:
        return values.copy()
    half, degree = width // 2, min(degree, width - 1)
    out = np.empty(n)
    powers = np.vander(np.arange(width), degree + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(powers)
    for i in range(n):
        a = min(max(i - half, 0), n - width)
        out[i] = np.vander([i - a], degree + 1, increasing=True)[0] @ (fit @ values[a : a + width])
    return out


def gumbel_density(x: np.ndarray, mu: float, beta: float) -> np.ndarray:
    z = (np.asarray(x, float) - mu) / beta
    return np.exp(-(z + np.exp(-z))) / beta


def merged_density(x: np.ndarray, models: list[tuple[float, float, float]]) -> np.ndarray:
    """Sum of Gumbel curves (mu, beta, weight) of partial results."""
    return sum((w * gumbel_density(x, m, b) for m, b, w in models), np.zeros(len(x)))


def _gumbel_target(counts: np.ndarray, top: int) -> tuple[int, np.ndarray, float]:
    """First bin, mixed raw and smoothed shares from it on, and where the fit starts."""
    counts = np.asarray(counts, float)
    start, end = _span(counts, top)
    raw = np.concatenate([counts, np.zeros(max(0, end + 1 - len(counts)))])[start : end + 1]
    width = min(7, end - start)
    width -= 1 - width % 2
    smooth = savgol(raw, width, min(5, width - 1)) if width >= 3 and len(raw) > width else raw.copy()
    smooth = np.maximum(smooth, 0)
    share = lambda v: v / v.sum() if v.sum() > 0 else v
    return start, 0.35 * share(smooth) + 0.65 * share(raw), start + (int(np.argmax(raw)) + int(np.argmax(smooth))) / 2


#: Rows that are fitted at once: their arrays stay in a core's cache. Bins whose exponentials are made from one.
_FIT_ROWS, _STRIDE = 32, 16


def _descend(made: list[tuple[int, np.ndarray, float]], steps: int, rate: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
    """mu and beta of each (first bin, target, start) by gradient descent on the squared difference.

    With e = exp(-z) the density is e * exp(-e) / beta. Bins are evenly spaced, so e is a
    product of a stride's first and a place in it, and sums with z are sums with the
    bin's number. A row ends when its difference is small or its step no longer changes it.
    """
    width = -(-max(len(t) for _, t, _ in made) // _STRIDE) * _STRIDE
    target, real = np.zeros((len(made), width)), np.zeros((len(made), width))
    for i, (_, t, _) in enumerate(made):
        target[i, : len(t)], real[i, : len(t)] = t, 1.0
    first, mu, beta = np.array([float(a) for a, _, _ in made]), np.array([float(m) for _, _, m in made]), np.full(len(made), 4.0)
    live, number = np.arange(len(made)), np.arange(width, dtype=float)
    strides, places = number[::_STRIDE], number[:_STRIDE]
    ones_numbers = np.column_stack([np.ones(width), number])
    low, high = np.exp(-50.0), np.exp(50.0)
    t, on = target, real
    e, p = np.empty_like(t), np.empty_like(t)
    for _ in range(steps):
        b, off = beta[live], first[live] - mu[live]
        inverse = (1 / b)[:, None]
        with np.errstate(over="ignore", under="ignore"):
            block = np.exp(-(off[:, None] + strides) * inverse)
            np.multiply(block[:, :, None], np.exp(-places * inverse)[:, None, :], out=e.reshape(len(live), -1, _STRIDE))
            np.clip(e, low, high, out=e)
            np.negative(e, out=p)
            np.exp(p, out=p)
            p *= e
            p *= on
            p *= inverse
            gap = p - t
            going = np.einsum("ij,ij->i", gap, gap) >= stop
            gap *= p
            whole, numbered = (gap @ ones_numbers).T
            gap *= e
            less, less_numbered = (gap @ ones_numbers).T
        u, scale = whole - less, 2 * rate * b
        # Sums of gap * p * (1 - e) * z, where z = (number + off) / b.
        uz = (numbered - less_numbered + off * u) / b
        new_mu, new_beta = mu[live] - scale * u, np.maximum(0.1, b - scale * (uz - whole))
        moved = going & ((new_mu != mu[live]) | (new_beta != b))
        mu[live[going]], beta[live[going]] = new_mu[going], new_beta[going]
        if not moved.all():
            live = live[moved]
            if not len(live):
                break
            t, on = target[live], real[live]
            e, p = np.empty_like(t), np.empty_like(t)
    return mu, beta


def gumbel_expect_many(rows: list[tuple], steps: int = 6000, rate: float = 0.12, stop: float = 1e-3) -> np.ndarray:
    """Expect values of (counts, hits, top) rows under Gumbel densities, fitted by gradient descent; NaN without a tail."""
    out = np.full(len(rows), np.nan)
    made = {i: _gumbel_target(counts, top) for i, (counts, hits, top) in enumerate(rows) if top > 0 and hits > 0}
    at = sorted(made, key=lambda i: len(made[i][1]))
    for k in range(0, len(at), _FIT_ROWS):
        some = at[k : k + _FIT_ROWS]
        for i, mu, beta in zip(some, *_descend([made[i] for i in some], steps, rate, stop), strict=True):
            out[i] = rows[i][1] * gumbel_density(np.array([rows[i][2]]), mu, beta)[0]
    return out


def gumbel_expect(counts: np.ndarray, hits: int, top: int) -> float:
    """Expect value of one histogram by a Gumbel fit."""
    return float(gumbel_expect_many([(counts, hits, top)])[0])


def dense(bins, counts) -> np.ndarray:
    """Counts by bin from 0 on."""
    out = np.zeros(int(max(bins)) + 2 if len(bins) else 1)
    for b, c in zip(bins, counts, strict=True):
        out[int(b)] += c
    return out


@pandas_udf(DoubleType())
def expect_tailfit_udf(bins: pd.Series, counts: pd.Series, hits: pd.Series, top: pd.Series) -> pd.Series:
    """expect_tailfit(bins array, counts array, hits, top bin)."""
    return pd.Series([tail_expect(dense(b, c), int(n), int(t)) for b, c, n, t in zip(bins, counts, hits, top, strict=True)])


@pandas_udf(DoubleType())
def expect_gumbel_udf(bins: pd.Series, counts: pd.Series, hits: pd.Series, top: pd.Series) -> pd.Series:
    """expect_gumbel(bins array, counts array, hits, top bin)."""
    return pd.Series(gumbel_expect_many([(dense(b, c), int(n), int(t)) for b, c, n, t in zip(bins, counts, hits, top, strict=True)]))
