"""Tail fits: known laws are found again, and odd tables have defined results."""

import pytest

from gridloom.operators import tails

FIT = "k int, side int, u double, n long, y double"


def test_fit_finds_the_law(spark):
    n, xi, scale = 4000, 0.3, 20.0
    y = [scale * ((1 - (i + 0.5) / n) ** -xi - 1) / xi for i in range(n)]
    over = spark.createDataFrame([(1, 1, 30.0, 80_000, v) for v in y], FIT)
    got = tails.gpd_fit(over, ["k"]).select("*", tails.gpd_var(0.01).alias("var"), tails.gpd_cvar(0.01).alias("cvar")).collect()
    assert len(got) == 1 and got[0]["n_over"] == n
    assert got[0]["xi"] == pytest.approx(xi, abs=0.02) and got[0]["scale"] == pytest.approx(scale, rel=0.03)
    assert got[0]["var"] == pytest.approx(30 + scale / xi * (5**xi - 1), rel=0.02) and got[0]["cvar"] > got[0]["var"]


def test_odd_tables(spark):
    few = spark.createDataFrame([(1, 1, 1.0, 9, 0.5)] * 29 + [(2, -1, 1.0, 9, 0.0)] * 40, FIT)
    assert tails.gpd_fit(few, ["k"]).count() == 0
    values = spark.createDataFrame([(1, None), (1, 2.0), (1, -9.0), (2, None)], "k int, x double")
    assert [(r["k"], r["side"], r["n"]) for r in tails.exceedances(values, ["k"], "x", 0.5).collect()] == [(1, -1, 2)]
    days = spark.createDataFrame([(f"d{i}", float(i), 2.0) for i in range(7)], "day string, v double, w double")
    weeks = tails.resampled_ratios(days, "day", "v", "w", paths=50).collect()
    assert len(weeks) == 50 and all(0 <= w["total"] <= 42 and w["ratio"] == pytest.approx(w["total"] / 14) for w in weeks)
    assert tails.resampled_ratios(days.limit(6), "day", "v", "w").count() == 0
    wide = spark.createDataFrame([(30.0, 1000, 50, 0.2, 10.0), (30.0, 1000, 50, 1.2, 10.0)], "u double, n long, n_over long, xi double, scale double")
    got = wide.select(tails.gpd_cvar(0.05).alias("at"), tails.gpd_cvar(0.01).alias("under")).collect()
    assert [r["at"] for r in got] == [None, None] and got[0]["under"] > 30 and got[1]["under"] == float("inf")


def test_greatest_likelihood_of_all_keys(spark):
    """Not below a fine search over both parameters, for heavy, light and bounded tails."""
    import numpy as np

    rng, rows, plain = np.random.default_rng(4), [], {}
    for k, xi in enumerate((0.6, 0.1, 0.0, -0.3)):
        u = rng.random(800)
        y = -3 * np.log(u) if xi == 0 else 3 * (u**-xi - 1) / xi
        plain[k] = y
        rows += [(k, 1, 10.0, 5000, float(v)) for v in y]
    rows += [(9, 1, 1.0, 9, 0.5)] * 5
    got = {r["k"]: r for r in tails.gpd_likelihood(spark.createDataFrame(rows, "k int, side int, u double, n long, y double"), ["k"]).collect()}
    assert got.keys() == plain.keys()

    def likelihood(y, xi, scale):
        z = 1 + xi * y / scale
        return -np.inf if (z <= 0).any() else -len(y) * np.log(scale) - (1 + 1 / xi) * np.log(z).sum()

    for k, y in plain.items():
        best = max(likelihood(y, xi, s) for xi in np.linspace(-0.6, 1.2, 181) + 1e-6 for s in np.linspace(1.5, 5, 141))
        assert likelihood(y, got[k]["xi"], got[k]["scale"]) >= best - 1e-6 and got[k]["n_over"] == 800
    assert tails.gpd_likelihood(spark.createDataFrame([], "k int, side int, u double, n long, y double"), ["k"]).count() == 0


def test_jumps_of_each_side(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    d = np.concatenate((rng.normal(0, 1, 4000), rng.lognormal(3, 0.2, 150), -rng.lognormal(4, 0.6, 60)))
    df = spark.createDataFrame([("z", float(x)) for x in d] + [("z", None), ("few", 1.0), ("few", 50.0)], "zone string, d double")
    got = {r["zone"]: r for r in tails.jump_moments(df, ["zone"], "d", 0.955).collect()}
    r, u = got["z"], np.quantile(abs(d), 0.955)
    up, down = np.log(d[d > u]), np.log(-d[-d > u])
    assert abs(r["up_mean"] - up.mean()) < 1e-9 and abs(r["down_sd"] - down.std()) < 1e-9 and r["down_mean"] > r["up_mean"] + 0.5
    assert got["few"]["up_mean"] is None and got["few"]["down_mean"] is None
