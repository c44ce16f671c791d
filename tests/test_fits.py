"""Fits against numpy, and odd tables."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import absolute, align, curves, fits, hedge, models, ranks, scores, searches, series, smooth
from gridloom.functions import features


def table(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0, 3, 0]
    y = x @ [2.0, -0.5, 4.0] + 7 + rng.normal(size=n)
    return x, y, rng.uniform(0.5, 2, n)


def test_weighted_standardised_ridge_against_numpy(spark):
    x, y, w = table()
    df = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w)] + [(1.0, None, 2.0, 3.0, 1.0)], "a double, b double, c double, y double, w double")
    mean = np.average(x, axis=0, weights=w)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z, t = (x - mean) / sd, y - np.average(y, weights=w)
    want = np.linalg.solve((z * w[:, None]).T @ z + 3 * np.eye(3), (z * w[:, None]).T @ t) / sd
    got = fits.ridge(df, "y", ["a", "b", "c"], 3.0, "w", True)
    assert [got[k] for k in "abc"] == pytest.approx(want.tolist()) and got["intercept"] == pytest.approx(float(np.average(y, weights=w) - mean @ want))
    plain = series.ridge(df, "y", ["a", "b", "c"], 2.0)
    design = np.column_stack((np.ones(len(x)), x))
    assert list(plain.values()) == pytest.approx(np.linalg.solve(design.T @ design + 2 * np.diag([0, 1, 1, 1]), design.T @ y).tolist())


def test_bounds_against_a_search_over_active_sets(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
        sums = np.column_stack((np.ones(60), x, y)).T @ np.column_stack((np.ones(60), x, y))
        bounds = {0: 0.0, 2: -0.1}
        got = fits.ridge_of(sums, [1, 2, 3], 4, 1.0, upper=bounds)
        best = None
        for held in ([], [0], [2], [0, 2]):  # every choice of bounds that hold
            free = [i for i in range(3) if i not in held]
            fixed = sum(bounds[i] * x[:, i] for i in held) if held else 0
            z = np.column_stack((np.ones(60), x[:, free]))
            b = np.linalg.solve(z.T @ z + np.diag([0, *[1.0] * len(free)]), z.T @ (y - fixed))
            full = np.zeros(3)
            full[free], full[held] = b[1:], [bounds[i] for i in held]
            if all(full[i] <= u + 1e-9 for i, u in bounds.items()):
                loss = ((y - b[0] - x @ full) ** 2).sum() + (full**2).sum()
                best = min(best or (loss, full), (loss, full), key=lambda s: s[0])
        assert got[1:] == pytest.approx(best[1], abs=1e-6)


def test_odd_tables(spark):
    df = spark.createDataFrame([], "a double, y double, ts timestamp, zone string")
    assert fits.ridge(df, "y", ["a"], 1.0) == {"intercept": 0.0, "a": 0.0} and series.ridge(df, "y", ["a"], 1.0) == {"intercept": 0.0, "a": 0.0}
    one = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 2.0, 1.0)], "ts timestamp, actual double, pred double")
    got = one.agg(*scores.headline()).first()
    assert (got["n"], got["mae"], got["bias"], got["r2"]) == (1, 1.0, 1.0, 0.0)
    assert one.limit(0).agg(*scores.headline()).first()["n"] == 0
    flat = spark.createDataFrame([("z", datetime.datetime(2024, 1, 1, h), 5.0) for h in range(5)], "zone string, ts timestamp, p double")
    assert [r["acf"] for r in series.lagged_moments(flat, ["zone"], "p", [1, 2]).collect()] == [None, None]
    assert [r["q"] for r in smooth.ljung_box(flat, ["zone"], "p", 2).collect()] == [None]
    assert fits.ar2(flat, ["zone"], "p").count() == 1 and fits.ar2(flat.limit(0), ["zone"], "p").count() == 0
    assert features.stabiliser(flat, "p").first()["b"] == 1.0


def test_reserved_looking_names_survive(spark):
    """Columns called like helpers come through as they were."""
    rows = spark.createDataFrame([("z", datetime.datetime(2024, 1, 1, h), float(h % 3), h, h, h, h) for h in range(6)], "zone string, ts timestamp, p double, side int, hit int, best int, place int")
    got = align.as_of(rows, rows.select("zone", "ts", F.col("p").alias("side"), F.col("p").alias("tie")), ["zone"], "side", "tie")
    assert got.columns == [*rows.columns, "_side"] and sorted(r["side"] for r in got.collect()) == list(range(6))
    assert [tuple(r) for r in align.latest(rows, ["zone"], "ts").collect()] == [("z", datetime.datetime(2024, 1, 1, 5), 2.0, 5, 5, 5, 5)]
    assert [(r["start"].hour, r["hours"]) for r in series.episodes(rows, ["zone"], F.col("p") > 0).orderBy("start").collect()] == [(1, 2), (4, 2)]
    rows2 = rows.withColumn("rank_a", F.col("p")).withColumn("rank_b", -F.col("p"))
    assert scores.spearman(rows2, ["zone"], "rank_a", "rank_b").first()["rho"] == pytest.approx(-1)


def test_isotonic_against_spans(spark):
    random.seed(4)
    rows = [(k, i, float(random.randrange(9))) for k in range(12) for i in range(random.randrange(1, 15))] + [(99, 0, None)]
    got = {(r["k"], r["i"]): r["fitted"] for r in curves.isotonic(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v").collect()}
    for k in range(12):
        v = [x for kk, _, x in rows if kk == k]
        mean = lambda a, b: sum(v[a : b + 1]) / (b - a + 1)
        assert [got[k, i] for i in range(len(v))] == pytest.approx([max(min(mean(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))])
    assert (99, 0) not in got


def test_rings(spark):
    bins = spark.createDataFrame([("z", i, float(i)) for i in range(6)], "zone string, bin int, m double")
    even = lambda w: {r["bin"]: r["m"] for r in series.circular_smooth(bins, ["zone"], "bin", "m", 6, w).collect()}
    assert even(1) == {i: float(i) for i in range(6)} and set(even(7).values()) == {2.5}
    assert even(3)[0] == pytest.approx(2.0) and sum(even(3).values()) == pytest.approx(15)
    with pytest.raises(ValueError):
        even(4)


def test_power_stretch_and_hedge_find_known_values(spark):
    rng = np.random.default_rng(8)
    raw = rng.uniform(1, 60, 3000)
    df = spark.createDataFrame([(float(x), float(1.4 * x**0.8), 1.0) for x in raw], "raw double, actual double, w double")
    assert absolute.power_stretch(df, "raw", "actual", "w") == pytest.approx((1.4, 0.8), rel=0.05)
    future = rng.normal(size=4000)
    pairs = spark.createDataFrame([(float(0.7 * f + e), float(f)) for f, e in zip(future, rng.normal(size=4000) * 0.2)], "s double, f double")
    found = hedge.least_cvar(pairs, "s", "f")
    assert found["ratio"] == pytest.approx(0.7, abs=0.05) and found["saved_percent"] > 60
    assert hedge.least_cvar(pairs.limit(0), "s", "f")["ratio"] == 0.0


def test_blocks_and_shares_of_odd_days(spark):
    rows = spark.createDataFrame([("d", h, float(h), float(-h)) for h in range(3)], "day string, hour int, actual double, pred double")
    assert ranks.blocks(rows, ["day"], ["actual"]).count() == 0 and ranks.block_choice(rows, ["day"], "actual", "pred").count() == 0
    share = ranks.shares_by_rank(rows, ["day"], "actual", "hour")
    assert ranks.share_distance(share, share.limit(0)).first()["l1"] == pytest.approx(1.0)


def test_quantile_lines_against_a_search(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 300)
    y = 2 * x + (1 + 0.3 * x) * rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for level in (0.1, 0.5, 0.9):
        loss = lambda a, b: np.mean(np.where(y > a + b * x, level * (y - a - b * x), (1 - level) * (a + b * x - y)))
        got = models.quantile_ridge(df, "y", ["x"], level)
        best = min(loss(a, b) for a in np.linspace(-4, 4, 81) for b in np.linspace(0, 4, 81))
        assert loss(got["intercept"], got["x"]) < best * 1.02 and np.mean(y <= got["intercept"] + got["x"] * x) == pytest.approx(level, abs=0.03)


def test_leaving_each_feature_out(spark):
    x, y, _ = table()
    z = np.column_stack((np.ones(len(x)), x, y))
    got = models.without_each(z.T @ z, ["a", "b", "c"])
    rss = lambda cols: float(np.linalg.lstsq(z[:, [0, *cols]], y, rcond=None)[1][0])
    assert [got[k] for k in "abc"] == pytest.approx([rss([j for j in (1, 2, 3) if j != i]) - rss([1, 2, 3]) for i in (1, 2, 3)])


def test_maps_and_couplings_find_known_laws(spark):
    rng = np.random.default_rng(12)
    x, a, b = rng.uniform(1, 80, 4000), rng.uniform(0, 90, 4000), rng.uniform(0, 90, 4000)
    laws = {"power": 1.3 * x**0.8, "log": -10 + 12 * np.log(0.3 * x + 2), "power_log": 15 * np.log(0.1 * x + 1) ** 1.4}
    couplings = {"floor": np.maximum(x, 0.7 * a + 0.2 * b), "excess": x + 0.5 * np.maximum(0.9 * (0.6 * a + 0.4 * b) - x, 0), "threshold": x + 0.4 * np.maximum(a - 40, 0) + 0.2 * np.maximum(b - 40, 0), "power": x + 20 * (a / 100 + 0.01) ** 1.5}
    names = [*laws, *(f"c_{f}" for f in couplings)]
    columns = [x, a, b, *laws.values(), *couplings.values()]
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(*columns)], ", ".join(f"{c} double" for c in ["x", "a", "b", *names]))
    fits_ = {k: searches.mapped(F.col("x"), k, searches.fit_map(df, "x", k, k)) for k in laws}
    fits_ |= {f"c_{f}": searches.coupled(F.col("x"), F.col("a"), F.col("b"), f, searches.fit_coupling(df, "x", "a", "b", f"c_{f}", f)) for f in couplings}
    got = df.agg(*[(F.avg(F.abs(F.col(n) - c)) / F.stddev_pop(n)).alias(n) for n, c in fits_.items()]).first().asDict()
    plain = df.agg(*[(F.avg(F.abs(F.col(n) - F.col("x"))) / F.stddev_pop(n)).alias(n) for n in fits_]).first().asDict()
    assert all(got[n] < 0.1 for n in laws) and all(got[n] < min(0.2, 0.7 * plain[n]) for n in fits_ if n.startswith("c_")), (got, plain)
    assert searches.fit_map(df.limit(0), "x", "power", "power") == [1.0, 1.0]


def test_least_absolute_error_under_skewed_noise(spark):
    """The rows' own optimum, not that of their means: within a thousandth of a row-by-row search."""
    rng = np.random.default_rng(21)
    x, w = rng.uniform(1, 60, 20_000), rng.uniform(0.5, 2, 20_000)
    y = x * rng.lognormal(0, 1, 20_000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, w)], "x double, y double, w double")
    loss = lambda p: 1e6 if p[0] <= 0 or not 0.5 <= p[1] <= 3 else float(np.average(np.abs(y - p[0] * x ** p[1]), weights=w))
    best = min((fits.nelder_mead(loss, s, 2000, 1e-7) for s in ([1.0, 1.0], [2.0, 0.8])), key=loss)
    assert loss(list(absolute.power_stretch(df, "x", "y", "w"))) <= 1.001 * loss(best)
    assert loss(searches.fit_map(df, "x", "y", "power", "w")) <= 1.002 * loss(best)
    log = lambda p: float(np.average(np.abs(y - p[0] - p[1] * np.log(p[2] * x + p[3])), weights=w)) if min(p[2:]) > 0 else 1e6
    assert log(searches.fit_map(df, "x", "y", "log", "w")) <= 1.01 * min(log(fits.nelder_mead(log, s, 4000, 1e-7)) for s in ([-10, 30, 0.1, 1], [0, 20, 0.05, 1]))
    assert absolute.power_stretch(df.limit(0), "x", "y", "w") == (1.0, 1.0)


def test_hedges_against_grid_searches(spark):
    """The smoothed objective of one and of two futures isn't above that of a grid search, and figures are of later rows."""
    rng = np.random.default_rng(31)
    f = rng.normal(size=(1500, 2))
    s = 0.8 * f[:, 0] - 0.4 * f[:, 1] + rng.standard_t(3, 1500)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, (b, c)) in enumerate(zip(s, f))] + [(5, None, 1.0, 1.0)], "t int, s double, f double, g double")
    phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))

    def objective(h, v, s, f):
        loss = f @ h - s
        w = max(1.06 * loss.std() * len(loss) ** -0.2, 1e-8)
        z = (loss - v) / w
        return v + np.mean((loss - v) * phi(z) + w * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)) / 0.05

    one = hedge.least_cvar(df, "s", "f")
    grid = min(objective(np.array([h]), v, s, f[:, :1]) for h in np.linspace(-1, 2, 31) for v in np.linspace(1, 5, 41))
    assert one["objective"] <= grid + 1e-4 and one["objective"] == pytest.approx(objective(np.array([one["ratio"]]), one["threshold"], s, f[:, :1]), abs=1e-4)
    two = hedge.least_cvar(df, "s", ["f", "g"])
    grid = min(objective(np.array([h, k]), v, s, f) for h in np.linspace(0, 1.6, 9) for k in np.linspace(-1.2, 0.4, 9) for v in np.linspace(1, 5, 21))
    assert two["objective"] <= grid + 1e-4 < one["objective"]
    later = hedge.least_cvar(df, "s", ["f", "g"], order="t")
    cut = 1500 * 0.55
    rest = np.arange(1500) > cut
    loss = f[rest] @ [later["ratio"], later["ratio_2"]] - s[rest]
    assert later["hedged"] == pytest.approx(loss[loss >= np.quantile(loss, 0.95)].mean(), rel=0.02)
