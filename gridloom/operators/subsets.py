"""Every set of features scored out of sample from one pass: sums of products by fold, prefix sums for training, and the sweep operator.

Sweeping a feature's pivot brings it into the fit, sweeping it again takes it out, so a walk through all sets in Gray order costs one sweep
a set. What the driver holds are matrices of the features, one a fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import fits

#: Sets of more features than these would be too many.
MOST = 16


def swept(a: np.ndarray, k: int) -> None:
    """Sweeps pivot k of a symmetric matrix in place; a second time undoes it. The sign of the swept pivot tells whether k is in."""
    d = a[k, k]
    column = a[:, k].copy()
    a -= np.outer(column, column) / d
    a[:, k] = a[k, :] = column / abs(d)
    a[k, k] = -1 / d


def walk(train: np.ndarray, test: np.ndarray, size: int, alpha: float, tiny: float = 1e-10) -> np.ndarray:
    """Squared errors on test of all sets, by their mask. train, test: matrices of the constant, the features and the target (last).

    A feature that what is in already tells (its pivot would be tiny) adds nothing: the set counts as that without it.
    """
    a = train + alpha * np.diag([0.0] + [1.0] * size + [0.0])
    scale, target = np.maximum(np.diag(a).copy(), 1e-300), size + 1
    swept(a, 0)
    out, mask, inside, refused = np.full(1 << size, np.nan), 0, {0}, set()
    for turn in range(1 << size):
        if turn:
            j = (turn & -turn).bit_length()  # the feature that Gray order turns
            mask ^= 1 << (j - 1)
            if j in inside:
                swept(a, j)
                inside.discard(j)
            elif j in refused:
                refused.discard(j)
            else:
                refused.add(j)
            for k in sorted(refused):  # one that was told before may no longer be
                if a[k, k] > tiny * scale[k]:
                    swept(a, k)
                    inside.add(k)
                    refused.discard(k)
        at = sorted(inside)
        b = a[at, target]
        out[mask] = test[target, target] - 2 * b @ test[at, target] + b @ test[np.ix_(at, at)] @ b
    return out


def every_set(rows: DataFrame, target: str, features: list[str], fold: Column, alpha: float = 0.0, first: int = 1) -> DataFrame:
    """features (comma-joined), size, n, rmse, r2, best: each set's ridge, fitted on all folds before each fold from the ``first`` on (in order of
    the fold's value) and scored on that fold, over all folds together. Rows with a null take no part; without two folds there is no row."""
    if len(features) > MOST:
        raise ValueError(f"at most {MOST} features")
    size, (name,) = len(features), fits.fresh_name(rows, "fold")
    sums = fits.sums_of_products(rows.withColumn(name, fold).filter(F.col(name).isNotNull()), [*features, target], keys=[name])
    found = [fits.matrix(r["m"], size + 2) for r in sorted(sums.collect(), key=lambda r: r[name])]  # a row a fold
    total, n, lost = sum(found[:first], np.zeros((size + 2, size + 2))), 0.0, np.zeros(1 << size)
    held = np.zeros((size + 2, size + 2))
    for test in found[first:]:
        if total[0, 0] > 0:
            lost += walk(total, test, size, alpha)
            held += test
        total = total + test
    n = held[0, 0]
    schema = "features string, size int, n long, rmse double, r2 double, best boolean"
    if n <= 0:
        return rows.sparkSession.createDataFrame([], schema)
    around = held[-1, -1] - held[0, -1] ** 2 / n
    told = [(",".join(f for i, f in enumerate(features) if m >> i & 1), m.bit_count(), int(n), float(np.sqrt(max(e, 0.0) / n)), float(1 - e / around) if around > 0 else 0.0, bool(m == int(np.argmin(lost)))) for m, e in enumerate(lost.tolist())]
    return rows.sparkSession.createDataFrame(told, schema)
