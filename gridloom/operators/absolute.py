"""Fits of least absolute error, and other losses that no sums of products tell, on all rows.

A search has two parts. It begins on the driver over a table of bounded size: cells cut along every column, the target included, each told by its
means. That is near the optimum but not at it, as the error of a cell's mean isn't the mean of its errors. Then a pattern is walked on
the rows themselves: a pass is one aggregate that gives the exact loss of every point of a small grid around the best so far; the grid moves
to a better point, and shrinks where there is none.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.names import fresh_name
from gridloom.session import settled

#: Grid points of a pass, at most about.
POINTS = 81


def cells(rows: DataFrame, columns: list[str], weight: str | None = None, most: int = 4096) -> dict[str, np.ndarray]:
    """Weighted means of the columns and the weight (``weight``) of at most about ``most`` cells; rows with nulls take no part."""
    side = max(2, int(most ** (1 / len(columns))))
    known = rows.select(*columns, (F.col(weight) if weight else F.lit(1.0)).alias("weight")).na.drop()
    cuts = fresh_name(known, *[f"cut_{i}" for i in range(len(columns))])
    edges = known.agg(*[F.percentile_approx(c, F.array(*[F.lit(i / side) for i in range(1, side)]), F.lit(100 * side)).alias(n) for c, n in zip(columns, cuts)])
    place = lambda c, n: F.size(F.filter(n, lambda e: e < F.col(c)))
    dealt = known.crossJoin(F.broadcast(edges)).groupBy(*[place(c, n).alias(f"at_{n}") for c, n in zip(columns, cuts)])
    table = dealt.agg(F.sum("weight").alias("weight"), *[F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum("weight")).alias(c) for c in columns]).filter("weight > 0").toPandas()
    return {c: table[c].to_numpy(float) for c in [*columns, "weight"]}


def mean_losses(rows: DataFrame, loss: Callable[[list[Column]], Column], points: list[list[float]], weight: str | None = None) -> list[float]:
    """The weighted mean of the loss over all rows at each point, from one aggregate; rows where it is null take no part.

    loss: a column of the parameters' columns. Points are data of the plan and not part of its code, so Spark compiles it once for all passes.
    """
    number, point, told = fresh_name(rows, "number", "point", "told")
    array = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, p)).alias("p")) for k, p in enumerate(points)])
    each = rows.withColumn("grid_points", F.explode(array)).withColumns({number: F.col("grid_points.k"), point: F.col("grid_points.p")})
    w = F.col(weight) if weight else F.lit(1.0)
    held = each.withColumn(told, loss([F.get(point, F.lit(i)) for i in range(len(points[0]))])).filter(F.col(told).isNotNull())
    found = held.groupBy(number).agg(F.try_divide(F.sum(w * F.col(told)), F.sum(w)).alias(told)).collect()  # a row a point
    by = {r[number]: r[told] for r in found}
    return [float("inf") if by.get(k) is None else float(by[k]) for k in range(len(points))]


def walked(rows: DataFrame, loss: Callable[[list[Column]], Column], start: list[float], spans: list[float], valid: Callable[[list[float]], bool] = lambda p: True, weight: str | None = None, passes: int = 20, tolerance: float = 1e-3) -> tuple[list[float], float]:
    """The point of least mean loss near a start, and that loss. spans: how far the first grid reaches to each side; it halves where the middle
    is best, until it is under ``tolerance`` of the first. Every pass reads all rows once."""
    side = 5 if 5 ** len(start) <= POINTS else 3
    steps = [2 * i / (side - 1) - 1 for i in range(side)]
    centre, reach, known = list(map(float, start)), np.array(spans, float), {}
    for _ in range(passes):
        grid = [[float(c + s * r) for c, s, r in zip(centre, step, reach)] for step in product(steps, repeat=len(start))]
        fresh = [p for p in grid if valid(p) and tuple(p) not in known]
        if fresh:
            known |= dict(zip(map(tuple, fresh), mean_losses(rows, loss, fresh, weight)))
        best = min(known, key=known.get, default=None)
        if best is None or known[best] == float("inf"):
            return list(start), float("inf")
        if list(best) == centre:
            reach = reach / 2
            if (reach <= tolerance * np.array(spans)).all():
                break
        centre = list(best)
    return centre, known[tuple(centre)]


def power_stretch(rows: DataFrame, raw: str, actual: str, weight: str, least: float = 0.5, most: float = 3.0) -> tuple[float, float]:
    """scale and power of least weighted mean absolute error of scale * raw ** power, over the rows themselves; actual below 0 counts as 0.

    Scale and power pull against each other, so the walk goes along the value at a middle of raw and the power. Without a row: (1, 1).
    """
    from gridloom.operators.fits import nelder_mead

    rows = settled(rows.select(raw, actual, weight))  # read once a pass
    t = cells(rows.withColumn(actual, F.greatest(F.col(actual), F.lit(0.0))), [raw, actual], weight)
    if not len(t["weight"]):
        return 1.0, 1.0
    x, w = np.maximum(t[raw], 0) + 1e-10, t["weight"]
    middle = float(np.exp(np.average(np.log(x), weights=w)))

    def near(p: list[float]) -> float:
        return 1e6 if p[0] <= 0 or not least <= p[1] <= most else float(np.average(np.abs(t[actual] - p[0] * x ** p[1]), weights=w))

    scale, power = nelder_mead(near, [1.0, 1.0], 1000)
    error = lambda p: F.abs(F.greatest(F.col(actual), F.lit(0.0)) - p[0] * F.pow((F.greatest(F.col(raw), F.lit(0.0)) + 1e-10) / middle, p[1]))
    level = scale * middle**power
    (level, power), _ = walked(rows, error, [level, power], [0.2 * level, 0.2], lambda p: p[0] > 0 and least <= p[1] <= most, weight)
    return level / middle**power, power
