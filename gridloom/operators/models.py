"""Models fitted over several passes or groups, each pass one aggregate: grouped ridges, quantile ridges, variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name
from gridloom.operators import fits


def grouped_ridge(rows: DataFrame, keys: list[str], target: str, features: list[str], alpha: float = 0.0, weight: str | None = None) -> DataFrame:
    """keys, feature, coef: a ridge for each key, all from one aggregate. Keys are models (segments, levels), so few; each is a small matrix
    that the driver solves."""
    sums = fits.sums_of_products(rows, [*features, target], weight, keys).collect()
    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", feature string, coef double"
    told = []
    for s in sums:
        b = fits.ridge_of(fits.matrix(s["m"], len(features) + 2), list(range(1, len(features) + 1)), len(features) + 1, alpha)
        told += [(*[s[k] for k in keys], f, float(c)) for f, c in zip(["intercept", *features], b)]
    return rows.sparkSession.createDataFrame(told, schema)


def quantile_ridge(rows: DataFrame, target: str, features: list[str], level: float, alpha: float = 0.0, rounds: int = 20, least: float = 1e-4) -> dict[str, float]:
    """Coefficients of the ``level`` quantile: ridges whose weights are what the pinball loss gives each row at the fit before, over its distance.

    Each round is one aggregate over the rows; distances under ``least`` (times the target's spread) count as that.
    """
    known = rows.select(target, *features).na.drop().persist()  # read once a round; what an executor loses is made anew
    spread = known.agg(F.stddev_pop(target)).first()[0] or 1.0
    fit = fits.ridge(known, target, features, alpha)
    (w,) = fresh_name(known, "weight")
    for _ in range(rounds):
        off = F.col(target) - fits.dot(fit)
        weighed = known.withColumn(w, F.when(off > 0, level).otherwise(1 - level) / F.greatest(F.abs(off), F.lit(least * spread)))
        new = fits.ridge(weighed, target, features, alpha, w)
        moved, fit = max(abs(new[f] - fit[f]) for f in fit), new
        if moved < 1e-6 * spread:
            break
    known.unpersist()
    return fit


def best_single(rows: DataFrame, target: str, candidates: list[str], train: Column) -> DataFrame:
    """feature, mae, best: each candidate's line, fitted on the train rows from one matrix, scored on the others in one pass."""
    used = rows.na.drop(subset=[target, *candidates])
    sums = fits.matrix(fits.sums_of_products(used.filter(train), [*candidates, target]).first()["m"], len(candidates) + 2)
    lines = {c: fits.ridge_of(sums, [i], len(candidates) + 1) for i, c in enumerate(candidates, 1)}
    errors = used.filter(~train).agg(*[F.avg(F.abs(F.col(target) - float(b[0]) - float(b[1]) * F.col(c))).alias(c) for c, b in lines.items()])
    each = errors.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mae")) for c in candidates])).alias("x")).select("x.*")
    return each.withColumn("best", F.col("mae") == F.min("mae").over(Window.partitionBy()))  # a row a candidate


def without_each(sums: np.ndarray, features: list[str], alpha: float = 0.0) -> dict[str, float]:
    """By how much the residual sum of squares grows without each feature; sums: the matrix of 1, the features and the target."""
    target = len(features) + 1

    def loss(some: list[int]) -> float:
        b = fits.ridge_of(sums, some, target, alpha)
        at = [0, *some]
        return float(sums[target, target] - 2 * b @ sums[at, target] + b @ sums[np.ix_(at, at)] @ b)

    every = list(range(1, target))
    return {f: loss([j for j in every if j != i]) - loss(every) for i, f in zip(every, features)}
