"""Exact likelihood against a plain filter, and every feature set against fitting each anew."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import statespace, subsets

START = datetime.datetime(2024, 1, 1)


def simulated(n=900, seed=9):
    rng = np.random.default_rng(seed)
    e, u, z = rng.normal(size=n), np.zeros(n), np.sin(np.arange(n) / 7)
    for t in range(2, n):
        u[t] = 0.9 * u[t - 1] - 0.3 * u[t - 2] + e[t] + 0.5 * e[t - 1]
    return 3 + u + 0.8 * z, z


def plain(y, x, point):
    """A filter step by step, with the law's own covariance to begin with; NaN is a missing hour."""
    a, b, m = point
    f, r = np.array([[a, 1.0], [b, 0.0]]), np.array([1.0, m])
    p = np.outer(r, r)
    for _ in range(5000):
        p = f @ p @ f.T + np.outer(r, r)
    p0 = p

    def run(beta):
        state, p, total, logs, n = np.zeros(2), p0, 0.0, 0.0, 0
        for t in range(len(y)):
            if t:
                state, p = f @ state, f @ p @ f.T + np.outer(r, r)
            if np.isnan(y[t]):
                continue
            error, size = y[t] - x[t] @ beta - state[0], p[0, 0]
            total, logs, n = total + error**2 / size, logs + np.log(size), n + 1
            gain = p[:, 0] / size
            state, p = state + gain * error, p - np.outer(gain, p[0])
        return total, logs, n, state

    def likelihood(beta):
        total, logs, n, _ = run(beta)
        return -0.5 * (n * (np.log(2 * np.pi * total / n) + 1) + logs)

    return likelihood, run


def test_likelihood_equals_a_plain_filter(spark):
    y, z = simulated(400)
    gone = {5, 6, 7, 200, *range(120, 190)}  # with a whole block of 64 missing
    rows = [(START + datetime.timedelta(hours=t), float(y[t]), float(z[t])) for t in range(400) if t not in gone]
    df = spark.createDataFrame([*rows, rows[0], (START + datetime.timedelta(hours=5), None, 1.0)], "ts timestamp, y double, z double")
    series = statespace.Series(df, "y", ["z"], 64)
    points = np.array([[0.9, -0.3, 0.5], [0.2, 0.1, -0.4], [1.2, -0.5, 0.0]])
    hidden = np.array([np.nan if t in gone else y[t] for t in range(400)])
    x = np.column_stack((np.ones(400), z))
    for point, (likelihood, beta, _) in zip(points, series.likelihoods(points), strict=True):
        of, _ = plain(hidden, x, point)
        assert likelihood == pytest.approx(of(beta), rel=1e-8)
        assert all(of(beta) >= of(beta + d) for d in (np.array([0.01, 0]), np.array([0, -0.01])))


def test_fit_finds_a_simulated_series_and_goes_on(spark):
    y, z = simulated(3000)
    df = spark.createDataFrame([(START + datetime.timedelta(hours=t), float(y[t]), float(z[t])) for t in range(3000)], "ts timestamp, y double, z double")
    m = statespace.fit(df, "y", ["z"])
    assert [m[k] for k in ("ar1", "ar2", "ma1", "z", "intercept")] == pytest.approx([0.9, -0.3, 0.5, 0.8, 3.0], abs=0.15)
    of, run = plain(y, np.column_stack((np.ones(3000), z)), [m["ar1"], m["ar2"], m["ma1"]])
    beta = np.array([m["intercept"], m["z"]])
    assert m["likelihood"] == pytest.approx(of(beta), rel=1e-8) and m["likelihood"] >= plain(y, np.column_stack((np.ones(3000), z)), [0.9, -0.3, 0.5])[0](beta) - 1e-6
    state = run(beta)[3]
    assert [m["state1"], m["state2"]] == pytest.approx(state.tolist(), abs=1e-6)
    future = spark.createDataFrame([(START + datetime.timedelta(hours=2999 + k), k, 0.5) for k in (1, 2)], "ts timestamp, step int, z double")
    got = [r["forecast"] for r in statespace.forecast(future, m, ["z"]).orderBy("ts").collect()]
    f = np.array([[m["ar1"], 1.0], [m["ar2"], 0.0]])
    assert got == pytest.approx([(np.linalg.matrix_power(f, k) @ state)[0] + m["intercept"] + 0.5 * m["z"] for k in (1, 2)], abs=1e-6)
    assert statespace.fit(df.limit(0), "y", ["z"]) == {}


def test_every_set_equals_fitting_each_anew(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 5))
    x[:, 3] = x[:, 0] + x[:, 1]  # told by two others
    y = x @ [1.0, -2.0, 0.5, 0.0, 0.0] + rng.normal(size=240)
    fold = np.arange(240) // 40
    df = spark.createDataFrame([(int(k), *map(float, r), float(v)) for k, r, v in zip(fold, x, y)] + [(1, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "k int, a double, b double, c double, d double, e double, y double")
    for alpha in (0.0, 2.0):
        got = {r["features"]: r["rmse"] for r in subsets.every_set(df, "y", list("abcde"), F.col("k"), alpha, 2).collect()}
        assert len(got) == 32
        for name, rmse in got.items():
            at, lost = ["abcde".index(f) for f in name.split(",") if f], 0.0
            for k in range(2, 6):
                train, test = fold < k, fold == k
                z = np.column_stack((np.ones(240), x[:, at]))
                left = z[train].T @ z[train] + alpha * np.diag([0] + [1] * len(at))
                lost += ((y[test] - z[test] @ (np.linalg.pinv(left) @ z[train].T @ y[train])) ** 2).sum()
            assert rmse == pytest.approx(np.sqrt(lost / 160), rel=1e-6), name
    assert subsets.every_set(df.limit(0), "y", ["a"], F.col("k")).count() == 0
