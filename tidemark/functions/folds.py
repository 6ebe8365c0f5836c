"""Valuation folds on numpy columns: many companies a step, for queries that value a company hundreds of times.

The arithmetic of ``valuation.dcf_value``, ``solve_monotone`` and ``run_dcf``, in its order of operations. NaN stands for
null. Arrays broadcast, so a column of companies meets a row of draws or rates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _line(first, last, t: int, years: int):
    return first + (last - first) * ((t - 1) / float(max(years - 1, 1)))


def flows(rev, growth: Callable[[int], np.ndarray], m1, mn, tax, years: int, da: float = 0.04, capex: float = 0.05, nwc: float = 0.02):
    """Free cash flow of every year, and the last year's revenue and operating profit."""
    out, ebit = [], None
    for t in range(1, years + 1):
        before, rev = rev, rev * (1 + growth(t))
        ebit = rev * _line(m1, mn, t, years)
        out.append(ebit - tax * np.maximum(ebit, 0.0) + rev * (da - capex) - nwc * (rev - before))
    return out, rev, ebit


def perpetuity(fcff, rate, terminal):
    return np.where(terminal < rate, fcff * (1 + terminal) / (rate - terminal), np.nan)


def present(flow: list, rate):
    out = 0.0
    for t, f in enumerate(flow, 1):
        out = out + f / np.power(1 + rate, t - 0.5)
    return out


def dcf_value(rev, g1, gn, m1, mn, tax, rate, terminal, years: int, growth: Callable[[int], np.ndarray] | None = None):
    """Enterprise value of a fading projection with a growing perpetuity; NaN where growth reaches the rate or revenue isn't positive."""
    with np.errstate(all="ignore"):
        rev = np.where(rev > 0, rev, np.nan)
        f, _, _ = flows(rev, growth or (lambda t: _line(g1, gn, t, years)), m1, mn, tax, years)
        return present(f, rate) + perpetuity(f[-1], rate, terminal) / np.power(1 + rate, years - 0.5)


def solve_monotone(value_at: Callable[[np.ndarray], np.ndarray], target: np.ndarray, low: float, high: float, steps: int = 60):
    """(root, reached, edge) of every row: where a function that rises or falls throughout meets a target, by halving."""
    lo, hi = np.full(len(target), float(low)), np.full(len(target), float(high))
    f_lo, f_hi = value_at(lo), value_at(hi)
    with np.errstate(all="ignore"):
        reached = (target >= np.fmin(f_lo, f_hi)) & (target <= np.fmax(f_lo, f_hi))
        edge = np.where(reached, np.nan, np.where(np.abs(f_lo - target) <= np.abs(f_hi - target), lo, hi))
        rises, known = f_hi > f_lo, ~np.isnan(f_hi) & ~np.isnan(f_lo)
        for _ in range(steps):
            mid = (lo + hi) / 2
            f = value_at(mid)
            right = ((f < target) == rises) & known & ~np.isnan(f)
            lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    return np.where(reached, (lo + hi) / 2, np.nan), reached, edge


def quantile(ordered: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Of rows that are sorted with NaN last, the interpolated quantile of each one's first n values."""
    at = p * np.maximum(n - 1, 0)
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    row = np.arange(len(n))
    a, b = ordered[row, low], ordered[row, high]
    return np.where(n == 0, np.nan, np.where(low == high, a, (high - at) * a + (at - low) * b))
