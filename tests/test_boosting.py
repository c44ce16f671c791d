"""Quantile boosting against a plain numpy version, and coverage on held-out rows."""

import numpy as np
import pytest

from gridloom.operators import boosting


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 10, (n, 3))
    return x, 3 * np.sin(x[:, 0]) + np.where(x[:, 1] > 5, 4.0, 0.0) + (0.5 + 0.3 * x[:, 0]) * rng.normal(size=n)


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")


def plain(model, x, y, level, trees, depth, rate, least):
    """The same trees, level by level in numpy, from the model's edges."""
    bins = np.array([[sum(e < v for e in edges) for v, edges in zip(row, model.edges)] for row in x])
    width, rank = max(map(len, model.edges)) + 1, lambda v, q: float(np.quantile(v, q, method="inverted_cdf"))
    told, grown = np.full(len(y), rank(y, level)), []
    for _ in range(trees):
        off, node, feats, cuts = y - told, np.zeros(len(y), int), [0] * (2**depth - 1), [width] * (2**depth - 1)
        g = np.where(off > 0, level, level - 1)
        for d in range(depth):
            for i in range(2**d - 1, 2 ** (d + 1) - 1):
                own = node == i
                if own.any():
                    best = (1e-9, 0, width)
                    for f in range(x.shape[1]):
                        for b in range(width - 1):
                            left = own & (bins[:, f] <= b)
                            right = own & (bins[:, f] > b)
                            if left.sum() >= least and right.sum() >= least:
                                gain = g[left].sum() ** 2 / left.sum() + g[right].sum() ** 2 / right.sum() - g[own].sum() ** 2 / own.sum()
                                if gain > best[0] + 1e-12:
                                    best = (gain, f, b)
                    feats[i], cuts[i] = best[1:]
            node = 2 * node + 1 + (bins[np.arange(len(y)), np.array(feats)[node]] > np.array(cuts)[node])
        leaves = [rate * rank(off[node == i], level) if (node == i).any() else 0.0 for i in range(2**depth - 1, 2 ** (depth + 1) - 1)]
        told = told + np.array(leaves)[node - (2**depth - 1)]
        grown.append((feats, cuts, leaves))
    return told, grown


def test_trees_equal_a_plain_version(spark):
    x, y = table(400, 3)
    df = frame(spark, x, y)
    model = boosting.quantile_boost(df, "y", ["a", "b", "c"], [0.2, 0.9], trees=3, depth=2, rate=0.5, bins=8)
    got = sorted((r["y"], r["q20"], r["q90"]) for r in model.predicted(df).collect())
    for k, level in enumerate((0.2, 0.9)):
        told, _ = plain(model, x, y, level, 3, 2, 0.5, 10)
        assert [r[1 + k] for r in got] == pytest.approx([v for _, v in sorted(zip(y, told))])


def test_coverage_on_held_out_rows(spark):
    x, y = table(6000, 5)
    model = boosting.quantile_boost(frame(spark, x, y), "y", ["a", "b", "c"], [0.1, 0.5, 0.9], trees=15)
    other, z = table(4000, 6)
    told = model.predicted(frame(spark, other, z)).toPandas()
    for level in (10, 50, 90):
        assert np.mean(told["y"] <= told[f"q{level}"]) == pytest.approx(level / 100, abs=0.02)
    loss = lambda pred: np.mean(np.where(z > pred, 0.9 * (z - pred), 0.1 * (pred - z)))
    assert loss(told.sort_values("y")["q90"].to_numpy()[np.argsort(np.argsort(z))]) < 0.8 * loss(np.quantile(y, 0.9))


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (None, 3.0, 2.0), (1.0, 1.0, None)], "a double, b double, y double")
    model = boosting.quantile_boost(df, "y", ["a", "b"], [0.5], trees=2, depth=2)
    assert {r["q50"] for r in model.predicted(df).collect()} == {2.0}
    assert {r["q50"] for r in boosting.quantile_boost(df.limit(0), "y", ["a", "b"], [0.5], trees=2).predicted(df).collect()} == {0.0}
