"""Forms with a few parameters that no sums of products tell: monotone output maps and couplings to neighbours.

A search begins on the driver over a table of cells, from points that the cells' own quantiles suggest, and ends on the rows themselves: see ``absolute``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.absolute import cells, walked
from gridloom.operators.fits import nelder_mead
from gridloom.session import settled

def _map(x, kind: str, p: list[float], up, log, power):
    if kind == "power":
        return p[0] * power(up(x, 0.0) + 1e-10, p[1])
    if kind == "log":
        return p[0] + p[1] * log(p[2] * up(x, 0.0) + p[3])
    return p[0] * power(log(p[1] * up(x, 0.0) + 1), p[2])


def _coupling(base, a, b, form: str, p: list[float], up, power):
    if form == "floor":
        return up(base, p[0] * a + p[1] * b)
    if form == "excess":
        return base + p[0] * up(p[1] * (0.6 * a + 0.4 * b) - base, 0.0)
    if form == "threshold":
        return up(base + p[0] * up(a - p[1], 0.0) + p[2] * up(b - p[1], 0.0), 0.0)
    return up(base + p[0] * power(up(a, 0.0) / 100 + 0.01, p[1]), 0.0)


def _valid(kind: str, p: list[float]) -> bool:
    if kind == "power":
        return p[0] > 0 and 0.5 <= p[1] <= 3
    return {"log": lambda: min(p[2:]) > 0, "power_log": lambda: p[0] > 0 and p[1] > 0 and p[2] > 0.3, "excess": lambda: 0 <= p[0] <= 1 and p[1] >= 0}.get(kind, lambda: min(p) >= 0)()


def mapped(x: Column, kind: str, p: list[float]) -> Column:
    """x through a power, a + b ln(c x + d) or a ln(b x + 1)^p; x below 0 counts as 0."""
    return _map(x, kind, p, lambda a, b: F.greatest(a, F.lit(b)), F.ln, lambda a, b: F.pow(a, b if isinstance(b, Column) else F.lit(b)))


def coupled(base: Column, a: Column, b: Column, form: str, p: list[float]) -> Column:
    """A base price held above neighbours (floor), with part of their excess, with what they are above a threshold, or with a power of the first."""
    up = lambda x, y: F.greatest(x, y if isinstance(y, Column) else F.lit(y))
    return _coupling(base, a, b, form, p, up, lambda x, y: F.pow(x, y if isinstance(y, Column) else F.lit(y)))


def _searched(loss, kind: str, starts: list[list[float]]) -> list[float]:
    bounded = lambda p: loss(p) if _valid(kind, p) else 1e6
    return min((nelder_mead(bounded, [float(v) for v in s], 600, 1e-4) for s in starts), key=bounded)


def _quantile(x: np.ndarray, weight: np.ndarray, level: float) -> float:
    order = np.argsort(x)
    return float(x[order][np.searchsorted(np.cumsum(weight[order]), level * weight.sum()).clip(0, len(x) - 1)])


def _map_starts(kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[list[float]]:
    """Maps through the target's middle, with the bend at a lower, middle or upper quantile of the input."""
    knots = [max(_quantile(x, w, q), 1e-3) for q in (0.1, 0.5, 0.9)]
    low, mid = _quantile(y, w, 0.1), max(_quantile(y, w, 0.5), 1e-3)
    if kind == "power":
        return [[mid / knots[1] ** p, p] for p in (0.7, 1.0, 1.5)]
    if kind == "log":
        return [[low, (mid - low) / np.log(2) if mid > low else 1.0, 1 / k, 1.0] for k in knots]
    return [[mid / np.log(knots[1] / k + 1) ** p, 1 / k, p] for k in knots for p in (1.0, 1.5)]


def _coupling_starts(form: str, a: np.ndarray, w: np.ndarray) -> list[list[float]]:
    """Weak and strong couplings, with the threshold at quantiles of the neighbour."""
    if form == "threshold":
        return [[s, _quantile(a, w, q), s / 2] for s in (0.1, 0.4) for q in (0.3, 0.6)]
    return {"floor": [[0.1, 0.1], [0.5, 0.5]], "excess": [[0.3, 0.3], [0.5, 1.0]]}.get(form) or [[0.1 * _quantile(a, w, 0.5), 1.5], [0.5 * _quantile(a, w, 0.5), 1.0]]


def _refined(rows: DataFrame, error, kind: str, start: list[float], weight: str | None) -> list[float]:
    """The walk on the rows; its first grid reaches a twentieth of each parameter."""
    return walked(rows, error, start, [max(abs(v) * 0.05, 1e-3) for v in start], lambda p: _valid(kind, p), weight, passes=8, tolerance=0.1)[0]


def fit_map(rows: DataFrame, raw: str, actual: str, kind: str, weight: str | None = None) -> list[float]:
    """The map of least weighted mean absolute error from raw to actual, over all rows; parameters that change nothing without a row."""
    rows = settled(rows.select(raw, actual, *([weight] if weight else [])))
    t = cells(rows, [raw, actual], weight)
    if not len(t["weight"]):
        return {"power": [1.0, 1.0], "log": [0.0, 1.0, 1.0, 1.0]}.get(kind, [1.0, 1.0, 1.0])
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    near = _searched(lambda p: float(np.average(np.abs(t[actual] - _map(t[raw], kind, p, np.maximum, safe, np.power)), weights=t["weight"])), kind, _map_starts(kind, t[raw], t[actual], t["weight"]))
    return _refined(rows, lambda p: F.abs(F.col(actual) - mapped(F.col(raw), kind, p)), kind, near, weight)


def fit_coupling(rows: DataFrame, base: str, a: str, b: str, actual: str, form: str, weight: str | None = None) -> list[float]:
    """The coupling of least weighted mean absolute error, over all rows; none without a row."""
    rows = settled(rows.select(base, a, b, actual, *([weight] if weight else [])))
    t = cells(rows, [base, a, b, actual], weight)
    if not len(t["weight"]):
        return [0.0, 1.0] if form == "power" else [0.0] * (3 if form == "threshold" else 2)
    near = _searched(lambda p: float(np.average(np.abs(t[actual] - _coupling(t[base], t[a], t[b], form, p, np.maximum, np.power)), weights=t["weight"])), form, _coupling_starts(form, t[a], t["weight"]))
    return _refined(rows, lambda p: F.abs(F.col(actual) - coupled(F.col(base), F.col(a), F.col(b), form, p)), form, near, weight)


def two_stage(features: dict[str, float], intercept: float, breaks: list[float], second: dict[str, float], second_intercept: float, bends: list[float], bend_first: float) -> Column:
    """A line in the features, then a line in the features, the first one's value and what that is above each break."""
    line = lambda c, i: sum((v * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, v in c.items()), F.lit(float(i)))
    one = line(features, intercept)
    over = [w * F.greatest(one - k, F.lit(0.0)) for k, w in zip(breaks, bends, strict=True)]
    return sum(over, line(second, second_intercept) + bend_first * one)

