"""Hedges and the mean of the worst losses, smoothed so that a search can follow it.

A search sends points to the rows and gets values and gradients back, one aggregate a pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.fits import matrix, sums_of_products
from gridloom.operators.tails import SHARE, SHARE_SCALE
from gridloom.session import settled


def smoothed_excess(d: Column, width: Column) -> Column:
    """The mean of what a normal law around d, of a width above 0, has above 0."""
    z = d / width
    t = 1 / (1 + SHARE_SCALE * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(SHARE):
        poly = (poly + c) * t
    density = F.exp(-0.5 * z * z) / np.sqrt(2 * np.pi)
    share = F.when(z < 0, poly * density).otherwise(1 - poly * density)
    return d * share + width * density


def kernel_cvar(losses: DataFrame, keys: list[str], loss: str, alpha: float = 0.05) -> DataFrame:
    """keys, cvar: the Rockafellar form at the 1 - alpha quantile, losses smeared by a normal kernel of Silverman's width.

    Where losses don't vary it is their value.
    """
    sums = losses.groupBy(*keys).agg(F.count(loss).alias("n"), F.stddev_pop(loss).alias("s"), F.percentile(loss, 1 - alpha).alias("v"))
    each = losses.join(sums, keys).withColumn("w", 1.06 * F.col("s") * F.pow("n", F.lit(-0.2)))  # a row a key
    d = F.col(loss) - F.col("v")
    over = smoothed_excess(d, F.col("w"))
    smooth = F.when(F.col("w") > 0, over).otherwise(F.greatest(d, F.lit(0.0)))
    return each.groupBy(*keys).agg((F.first("v") + F.avg(smooth) / alpha).alias("cvar"))


def _objective(rows: DataFrame, points: list[np.ndarray], alpha: float, n: float, spread) -> list[tuple[float, np.ndarray]]:
    """Value and gradient of the smoothed objective at each point (ratios, then the threshold), from one pass over rows (s and f, an array).

    spread: from ratios to the width of the kernel and its gradient. Points are data of the plan, so Spark compiles it once for all passes.
    """
    told = [(p.tolist(), *spread(p[:-1])) for p in points]
    array = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, p)).alias("p"), F.lit(float(w)).alias("w")) for k, (p, w, _) in enumerate(told)])
    size = len(points[0]) - 1
    each = rows.withColumn("o", F.explode(array)).select("s", "f", "o.*")
    hedged = sum((F.get("f", F.lit(j)) * F.get("p", F.lit(j)) for j in range(size)), F.lit(0.0))
    d = hedged - F.col("s") - F.get("p", F.lit(size))
    each = each.withColumn("d", d).withColumn("e", smoothed_excess(F.col("d"), F.col("w"))).withColumn("g", F.exp(-0.5 * F.pow(F.col("d") / F.col("w"), 2)) / np.sqrt(2 * np.pi))
    above = (F.col("e") - F.col("w") * F.col("g")) / F.when(F.col("d") == 0, F.lit(1.0)).otherwise(F.col("d"))
    each = each.withColumn("a", F.when(F.col("d") == 0, 0.5).otherwise(above))
    sums = each.groupBy("k").agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum("g").alias("g"), *[F.sum(F.get("f", F.lit(j)) * F.col("a")).alias(f"f{j}") for j in range(size)])
    found = {r["k"]: r for r in sums.collect()}  # a row a point
    out = []
    for k, (p, _, slope) in enumerate(told):
        r = found[k]
        gradient = [(r[f"f{j}"] + r["g"] * slope[j]) / (alpha * n) for j in range(size)] + [1 - r["a"] / (alpha * n)]
        out.append((p[-1] + r["e"] / (alpha * n), np.array(gradient)))
    return out


def least_cvar(rows: DataFrame, spot: str, futures: str | list[str], alpha: float = 0.05, most: float = 5.0, order: str | None = None, train: float = 0.55, passes: int = 40) -> dict[str, float]:
    """The shares of one or more futures, each within -most and most, that leave the least mean of the worst losses, smeared by a normal kernel of
    Silverman's width: ratio (ratio_2, ..), threshold, objective, and unhedged, hedged, saved_percent (plain tail means).

    rows: changes of spot and futures. The objective is convex in ratios and threshold together, and a pass over all rows tells its value and
    gradient at several points: a quasi-Newton walk tries eight lengths of each step at once. With ``order`` (a time) the walk is fitted on the
    first ``train`` of the rows and the tail means are of those behind them, else of all. Rows with a null take no part; without a
    row, or where the losses don't vary, ratios are 0.
    """
    names = [futures] if isinstance(futures, str) else list(futures)
    known = rows.select(F.col(spot).cast("double").alias("s"), F.array(*[F.col(c).cast("double") for c in names]).alias("f"), *([F.col(order).alias("t")] if order else []))
    known = settled(known.filter(F.col("s").isNotNull() & F.forall("f", lambda x: x.isNotNull())))
    fitted, scored = known, known
    if order:
        cut = known.agg(F.percentile_approx(F.col("t").cast("double"), train, 10_000)).first()[0]
        fitted, scored = known.filter(F.col("t").cast("double") <= F.lit(cut)), known.filter(F.col("t").cast("double") > F.lit(cut))
    size = len(names)
    columns = [F.col("s"), *[F.get("f", F.lit(j)) for j in range(size)]]
    sums = fitted.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    m = matrix(sums_of_products(sums, [f"c{i}" for i in range(size + 1)]).first()["m"], size + 2)
    ratios = [f"ratio_{j + 1}" if j else "ratio" for j in range(size)]
    n = m[0, 0]
    cov = m[1:, 1:] / n - np.outer(m[0, 1:], m[0, 1:]) / n**2 if n else np.zeros((size + 1, size + 1))
    if n < 2 or cov[0, 0] <= 1e-18:
        return {**dict.fromkeys(ratios, 0.0), "threshold": 0.0, "objective": 0.0, "unhedged": 0.0, "hedged": 0.0, "saved_percent": 0.0}
    scale = 1.06 * n**-0.2

    def spread(h: np.ndarray) -> tuple[float, np.ndarray]:
        x = np.concatenate(([-1.0], h))
        sd = max(float(np.sqrt(max(x @ cov @ x, 0.0))), 1e-12)
        return max(scale * sd, 1e-8), scale * (cov[1:] @ x) / sd

    def held(p: np.ndarray) -> np.ndarray:
        return np.concatenate((np.clip(p[:-1], -most, most), p[-1:]))

    start = np.clip(np.linalg.lstsq(cov[1:, 1:], cov[1:, 0], rcond=None)[0], -most, most)  # of least variance
    loss = sum((F.get("f", F.lit(j)) * float(start[j]) for j in range(size)), F.lit(0.0)) - F.col("s")
    at = np.concatenate((start, [float(fitted.agg(F.percentile_approx(loss, 1 - alpha, 10_000)).first()[0])]))
    (value, gradient), = _objective(fitted, [at], alpha, n, spread)
    inverse, lengths = np.eye(size + 1) * spread(at[:-1])[0], [2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001]
    for _ in range(passes):
        step = -inverse @ gradient
        if step @ gradient >= 0:
            inverse = np.eye(size + 1) * spread(at[:-1])[0]
            step = -inverse @ gradient
        points = [held(at + k * step) for k in lengths]
        told = _objective(fitted, points, alpha, n, spread)
        best = min(range(len(points)), key=lambda k: told[k][0])
        if told[best][0] >= value - 1e-10 * max(1.0, abs(value)):
            break
        moved, change = points[best] - at, told[best][1] - gradient
        at, (value, gradient) = points[best], told[best]
        if moved @ change > 1e-14:
            r = 1 / (moved @ change)
            left = np.eye(size + 1) - r * np.outer(moved, change)
            inverse = left @ inverse @ left.T + r * np.outer(moved, moved)
    h = at[:-1]
    worst = lambda h: _tail_mean(scored.select((sum((F.get("f", F.lit(j)) * float(h[j]) for j in range(size)), F.lit(0.0)) - F.col("s")).alias("l")), alpha)
    plain, hedged = worst(np.zeros(size)), worst(h)
    return {**dict(zip(ratios, h.tolist())), "threshold": float(at[-1]), "objective": float(value), "unhedged": plain, "hedged": hedged, "saved_percent": 100 * (plain - hedged) / abs(plain) if plain else 0.0}


def _tail_mean(losses: DataFrame, alpha: float) -> float:
    cut = losses.agg(F.percentile("l", 1 - alpha).alias("cut"))
    return float(losses.crossJoin(F.broadcast(cut)).filter("l >= cut").agg(F.avg("l")).first()[0] or 0.0)
