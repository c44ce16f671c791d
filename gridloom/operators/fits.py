"""Fits from aggregated sums of products: the data is read once, and what the driver solves has the size of the features.

Every fit takes rows without nulls in its columns; others are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name


def time_weights(rows: DataFrame, half_life_days: float, order: str = "ts") -> DataFrame:
    """rows with ``weight``: halved every half-life before the newest row, adding up to the number of rows; 1 without a half-life."""
    if half_life_days <= 0:
        return rows.withColumn("weight", F.lit(1.0))
    newest, total, n = fresh_name(rows, "newest", "total", "n")
    age = (F.col(newest) - F.unix_timestamp(order)) / 3600
    ends = rows.agg(F.max(F.unix_timestamp(order)).alias(newest), F.count("*").alias(n))
    aged = rows.crossJoin(F.broadcast(ends)).withColumn("weight", F.exp(-np.log(2.0) / (half_life_days * 24) * age))  # one row is broadcast
    sums = aged.agg(F.sum("weight").alias(total))
    return aged.crossJoin(F.broadcast(sums)).withColumn("weight", F.col("weight") * F.col(n) / F.col(total)).drop(newest, total, n)


def sums_of_products(rows: DataFrame, columns: list[str], weight: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys and ``m``: the upper triangle of the matrix of weighted sums of products of 1 and the columns, row by row."""
    used = rows.na.drop(subset=[*columns, *([weight] if weight else [])])
    w, terms = F.col(weight) if weight else F.lit(1.0), [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    cells = [F.sum(w * terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    return used.groupBy(*(keys or [])).agg(F.array(*cells).alias("m"))


def matrix(m: list[float | None], size: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle; nulls (no rows) count as 0."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = [x or 0.0 for x in m]
    return out + np.triu(out, 1).T


def ridge_of(sums: np.ndarray, features: list[int], target: int, alpha: float = 0.0, standard: bool = False, upper: dict[int, float] | None = None) -> np.ndarray:
    """Intercept and coefficients of the features (numbers of columns of the sums, where 0 is the intercept's) from one matrix.

    The penalty leaves out the intercept. standard: it falls on features in standard deviations (of 1 where there is none). upper: bounds
    by place among the features; those that a solution breaks are set to their bounds, one after the other, the worst first,
    and set free again where the slope there points inwards.
    """
    n = sums[0, 0]
    if n <= 0:
        return np.zeros(len(features) + 1)
    mean, y = sums[0, features] / n, sums[0, target] / n
    gram = sums[np.ix_(features, features)] - n * np.outer(mean, mean)
    right = sums[features, target] - n * mean * y
    scale = np.sqrt(np.maximum(np.diag(gram) / n, 0)) if standard else np.ones(len(features))
    scale = np.where(scale < 1e-10, 1.0, scale)
    left = gram / np.outer(scale, scale) + alpha * np.eye(len(features))
    right, bound = right / scale, {i: u * scale[i] for i, u in (upper or {}).items()}
    held: set[int] = set()
    b = np.zeros(len(features))
    for _ in range(4 * len(features) + 1):
        free = [i for i in range(len(features)) if i not in held]
        b[list(held)] = [bound[i] for i in held]
        if free:
            b[free] = np.linalg.lstsq(left[np.ix_(free, free)], right[free] - left[np.ix_(free, list(held))] @ b[list(held)], rcond=None)[0]
        broken = {i: b[i] - bound[i] for i in free if i in bound and b[i] > bound[i] + 1e-12}
        slope = left @ b - right
        inward = [i for i in held if slope[i] > 1e-9]
        if broken:
            held.add(max(broken, key=broken.get))
        elif inward:
            held.discard(inward[0])
        else:
            break
    b = b / scale
    return np.concatenate(([y - mean @ b], b))


def ridge(rows: DataFrame, target: str, features: list[str], alpha: float = 0.0, weight: str | None = None, standard: bool = False, upper: dict[str, float] | None = None) -> dict[str, float]:
    """The fit over all rows, by name."""
    sums = matrix(sums_of_products(rows, [*features, target], weight).first()["m"], len(features) + 2)
    b = ridge_of(sums, list(range(1, len(features) + 1)), len(features) + 1, alpha, standard, {features.index(f): u for f, u in (upper or {}).items()})
    return dict(zip(["intercept", *features], b.tolist()))


def dot(coefficients: dict[str, float]) -> Column:
    """The linear term as a column; a null feature counts as 0."""
    terms = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * c for f, c in coefficients.items() if f != "intercept"]
    return sum(terms, F.lit(float(coefficients.get("intercept", 0.0))))


def log_linear(linear: Column, offset: float, scale: float = 1.0, power: float = 1.0, cap: float = 20.0) -> Column:
    """scale times (e to the linear term, held at a cap, less an offset, not below 0) to a power."""
    raw = F.greatest(F.exp(F.least(linear, F.lit(cap))) - offset, F.lit(0.0))
    return F.when(raw > 0, scale * F.pow(raw, F.lit(power))).otherwise(F.when(raw.isNotNull(), F.lit(0.0)))


def nelder_mead(loss, start: list[float], rounds: int = 200, tolerance: float = 1e-3) -> list[float]:
    """The least of a loss over a few parameters by a simplex that reflects, grows, shrinks."""
    points = [np.array(start, float)] + [np.array(start, float) + np.where(np.arange(len(start)) == i, 0.05 * s if s else 0.00025, 0) for i, s in enumerate(start)]
    scored = sorted(((loss(p.tolist()), i, p) for i, p in enumerate(points)), key=lambda s: s[:2])
    number = len(points)
    for _ in range(rounds):
        best, worst = scored[0], scored[-1]
        if max(np.abs(s[2] - best[2]).max() for s in scored) <= tolerance:
            break
        centre = np.mean([s[2] for s in scored[:-1]], axis=0)
        number += 1
        at = lambda k: (loss((p := centre + k * (centre - worst[2])).tolist()), number, p)
        once = at(1.0)
        if once[0] < best[0]:
            new = min(once, at(2.0), key=lambda s: s[0])
        elif once[0] < scored[-2][0]:
            new = once
        else:
            new = at(0.5) if once[0] < worst[0] else at(-0.5)
            if new[0] >= min(once[0], worst[0]):
                scored = [best] + [(loss((p := best[2] + 0.5 * (s[2] - best[2])).tolist()), s[1], p) for s in scored[1:]]
                scored.sort(key=lambda s: s[:2])
                continue
        scored = sorted([*scored[:-1], new], key=lambda s: s[:2])
    return scored[0][2].tolist()


def ar2(rows: DataFrame, keys: list[str], value: str, most_root: float | None = None, accept: Column | None = None) -> DataFrame:
    """keys, phi1, phi2: least squares of a series on its last two rows, from five sums; (0.7, 0) where these don't tell them apart.

    With most_root, both are scaled down where the larger root of their recursion is beyond it. accept: which rows take part.
    """
    y, a, b = fresh_name(rows, "y", "last", "before")
    order = Window.partitionBy(*keys).orderBy("ts")
    wide = rows.select(*keys, "ts", F.col(value).alias(y), F.lag(value, 1).over(order).alias(a), F.lag(value, 2).over(order).alias(b), (accept if accept is not None else F.lit(True)).alias("accepted"))
    wide = wide.filter(F.col("accepted")).na.drop(subset=[y, a, b])
    product = lambda i, j: F.sum(F.col(i) * F.col(j))
    sums = wide.groupBy(*keys).agg(product(a, a).alias("aa"), product(a, b).alias("ab"), product(b, b).alias("bb"), product(a, y).alias("ay"), product(b, y).alias("bz"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    thin = F.abs(det) < 1e-9
    one = F.when(thin, F.lit(0.7)).otherwise(F.try_divide(F.col("ay") * F.col("bb") - F.col("bz") * F.col("ab"), det))
    two = F.when(thin, F.lit(0.0)).otherwise(F.try_divide(F.col("bz") * F.col("aa") - F.col("ay") * F.col("ab"), det))
    out = sums.select(*keys, one.alias("phi1"), two.alias("phi2"))
    if most_root is None:
        return out
    inside = F.col("phi1") * F.col("phi1") + 4 * F.col("phi2")
    root = F.when(inside >= 0, (F.abs("phi1") + F.sqrt(F.abs(inside))) / 2).otherwise(F.sqrt(F.abs("phi2")))
    share = F.when(root > most_root, most_root / root).otherwise(F.lit(1.0))
    return out.select(*keys, (F.col("phi1") * share).alias("phi1"), (F.col("phi2") * share).alias("phi2"))


def recursion(last: Column, before: Column, phi1: Column, phi2: Column, steps: int) -> Column:
    """The next ``steps`` values of an AR(2) from its last two, as an array."""
    start = F.struct(last.alias("a"), before.alias("b"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        new = phi1 * s["a"] + phi2 * s["b"]
        return F.struct(new.alias("a"), s["a"].alias("b"), F.array_append(s["out"], new).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"])


def remainder(rows: DataFrame, target: str, proxy: str, train: Column) -> DataFrame:
    """rows with ``remainder``: the target less the line on the proxy that the train rows give; the whole target without such rows."""
    slope, level = fresh_name(rows, "slope", "level")
    marked = F.when(train, F.col(target)), F.when(train, F.col(proxy))
    line = rows.agg(F.regr_slope(*marked).alias(slope), F.regr_intercept(*marked).alias(level))
    out = rows.crossJoin(F.broadcast(line))  # one row is broadcast
    return out.withColumn("remainder", F.col(target) - F.coalesce(F.col(level) + F.col(slope) * F.col(proxy), F.lit(0.0))).drop(slope, level)


def faded(lead_hours: Column, whole: float = 42.0, half_life: float | None = None) -> Column:
    """The weight of a feature that is known for some hours: 1 up to there, then 0, or halved every half-life."""
    after = F.lit(0.0) if half_life is None else F.pow(F.lit(0.5), (lead_hours - whole) / half_life)
    return F.when(lead_hours <= whole, F.lit(1.0)).otherwise(after)
