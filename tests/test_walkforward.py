"""Walk-forward refits from prefix sums against refitting each period from its rows with numpy."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import walkforward
from gridloom.operators.walkforward import Bin, Model

START = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)
MODEL = Model("y", (("z", 0), ("y", 24), ("w", 3)), (Bin(F.hour, 24), Bin(F.weekday, 7)), lambda ts: F.date_trunc("week", ts), "1 hour", 2.0, plain=("w",))


def series(n=24 * 30, seed=4):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    z, w, e = np.cos(t / 5) + rng.normal(size=n), (rng.random(n) < 0.3).astype(float), np.zeros(n)
    for i in range(1, n):
        e[i] = 0.6 * e[i - 1] + rng.normal()
    return 40 + 8 * np.sin(t % 24 / 24 * 6.28) + 3 * (t // 24 % 7 > 4) + 2 * z + 4 * np.roll(w, 3) + e, z, w


def frame(spark, zones=("a", "b"), gaps=(100, 101, 700)):
    rows = []
    for k, zone in enumerate(zones):
        y, z, w = series(seed=4 + k)
        rows += [(zone, START + i * HOUR, None if i == 333 else float(y[i]), float(z[i]), float(w[i])) for i in range(len(y)) if i not in gaps]
    return spark.createDataFrame(rows, "zone string, ts timestamp, y double, z double, w double")


def plain(rows, least=30, limit=None):
    """For each row by the rows before its week: season, linear part, phi; every period fitted from scratch."""
    by = {r["ts"]: (r["y"], r["z"], r["w"]) for r in rows}
    week = lambda t: (t - datetime.timedelta(days=t.weekday())).replace(hour=0)
    out, nan = {}, float("nan")
    for start in sorted({week(t) for t in by}):
        cut = limit or start
        parts = {}
        for c in (0, 1):
            known = {t: v[c] for t, v in by.items() if t < cut and v[c] is not None}
            hours = [np.mean([v for t, v in known.items() if t.hour == h] or [0]) for h in range(24)]
            days = [np.mean([v - hours[t.hour] for t, v in known.items() if t.weekday() == d] or [0]) for d in range(7)]
            parts[c] = lambda t, hours=hours, days=days: hours[t.hour] + days[t.weekday()]
        parts[2] = lambda t: 0.0
        left = lambda t, c: nan if t not in by or by[t][c] is None else by[t][c] - parts[c](t)
        line = lambda t: [left(t, 1), left(t - 24 * HOUR, 0), left(t - 3 * HOUR, 2), left(t, 0)]
        whole = [t for t in by if t < cut and np.isfinite(line(t) + line(t - HOUR)).all()]
        if len(whole) < least:
            continue
        x = np.array([line(t) for t in whole])
        m = x.mean(axis=0)
        b = np.linalg.solve((x - m)[:, :3].T @ (x - m)[:, :3] + 2 * np.eye(3), (x - m)[:, :3].T @ (x - m)[:, 3])
        b0 = m[3] - m[:3] @ b
        error = lambda t: line(t)[3] - b0 - np.array(line(t)[:3]) @ b
        now, before = np.array([error(t) for t in whole]), np.array([error(t - HOUR) for t in whole])
        phi = now @ before / (before @ before)
        for t in by:
            if week(t) == start:
                out[t] = (parts[0](t), b0 + np.nan_to_num(line(t)[:3]) @ b, phi, len(whole))
    return out


def test_every_week_equals_a_refit_from_scratch(spark):
    df = frame(spark)
    got = walkforward.walk_forward(df, ["zone"], MODEL).collect()
    assert len(got) > 900
    for zone in ("a", "b"):
        want = plain(df.filter(F.col("zone") == zone).collect())
        own = {r["ts"]: (r["season"], r["linear"], r["phi"], r["n"]) for r in got if r["zone"] == zone}
        assert own.keys() == want.keys()
        for t in own:
            assert own[t] == pytest.approx(want[t], abs=1e-7)


def test_frozen_model_and_horizons(spark):
    df = frame(spark, ("a",))
    rows, cut = df.collect(), datetime.datetime(2024, 1, 22)
    want = plain(rows, limit=cut)
    got = {r["ts"]: (r["season"], r["linear"]) for r in walkforward.replay(df.drop("zone"), [], MODEL, F.lit(cut)).collect()}
    assert min(got) == cut and all(v == pytest.approx(want[t][:2], abs=1e-7) for t, v in got.items())
    own = {r["ts"]: r for r in walkforward.walk_forward(df, ["zone"], MODEL).collect()}
    for r in walkforward.horizon(df, ["zone"], MODEL, F.hour("ts") == 6, [1, 24, 30]).collect():
        if r["origin"].isocalendar()[1] == r["ts"].isocalendar()[1]:
            model, at = own[r["ts"]], own[r["origin"]]
            error = 0.0 if at["actual"] is None else at["actual"] - at["season"] - at["linear"]
            assert r["lead"] in (1, 24, 30) and r["ts"] - r["origin"] == r["lead"] * HOUR
            if r["lead"] == 30:  # nothing but the season and the constant is known so long before
                assert abs(r["pred"] - model["season"] - model["phi"] ** 30 * error) < 5
    # what comes after an origin has no part in its forecasts
    later = df.withColumn("z", F.when(F.col("ts") > "2024-01-25 06:00:00", F.col("z") + 100).otherwise(F.col("z")))
    told = lambda d: {r["lead"]: r["pred"] for r in walkforward.horizon(d, ["zone"], MODEL, F.col("ts") == "2024-01-25 06:00:00", [1, 24, 30]).collect()}
    assert told(df) == pytest.approx(told(later))


def test_odd_tables(spark):
    df = frame(spark, ("a",))
    assert walkforward.walk_forward(df.limit(0), ["zone"], MODEL).count() == 0
    assert walkforward.walk_forward(df.filter("ts < '2024-01-02'"), ["zone"], MODEL).count() == 0
    odd = df.unionByName(df.limit(5)).unionByName(spark.createDataFrame([("a", None, 1.0, 1.0, 1.0)], df.schema)).withColumn("period", F.lit("x"))
    assert walkforward.walk_forward(odd, ["zone"], MODEL).count() == walkforward.walk_forward(df, ["zone"], MODEL).count()
