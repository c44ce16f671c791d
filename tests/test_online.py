"""The interval fold against a plain walk with the surveyed application's 15 steps."""

import datetime
import math
import random

from pyspark.sql import functions as F

from gridloom.streaming import online

STEPS = [0.0005, 0.001, 0.002, 0.003, 0.005, 0.008, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2]


def quantile(values, level):
    s = sorted(values)
    at = level * (len(s) - 1)
    low = min(int(at), len(s) - 1)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def walk(rows):
    levels, losses, window, out = [0.1] * 15, [0.0] * 15, [], []
    held = lambda x: max(1e-6, min(1 - 1e-6, x))
    for n, (actual, pred) in enumerate(rows):
        each = [math.exp(-5.0 * (x - min(losses))) for x in losses]
        level = held(sum(w / sum(each) * a for w, a in zip(each, levels)))
        half = quantile(window, 1 - level) if n >= 24 else 0.0
        out.append((pred - half, pred + half))
        score = abs(actual - pred)
        for k, step in enumerate(STEPS):
            miss = float(score > (quantile(window, 1 - levels[k]) if window else 0.0))
            levels[k], losses[k] = held(levels[k] + step * (0.1 - miss)), 0.99 * losses[k] + miss
        window = [*window, score][-720:]
    return out


def test_intervals_against_a_plain_walk(spark):
    random.seed(8)
    rows = [(1.0, 1.0), *((random.gauss(0, 1 + i // 200), 0.1) for i in range(800))]
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("z", start + datetime.timedelta(hours=i), a, p) for i, (a, p) in enumerate(rows)], "zone string, ts timestamp, actual double, pred double")
    got = sorted((r["ts"], r["lower"], r["upper"]) for r in online.conformal_intervals(df, "zone").collect())
    for (_, lower, upper), want in zip(got, walk(rows), strict=True):
        assert abs(lower - want[0]) < 1e-9 and abs(upper - want[1]) < 1e-9


def series(spark, n=120, zones=("a", "b")):
    random.seed(11)
    start = datetime.datetime(2024, 1, 1)
    rows = [(z, start + datetime.timedelta(hours=i), random.gauss(10, 3), random.gauss(9, 1)) for z in zones for i in range(n)]
    return spark.createDataFrame(rows, "zone string, ts timestamp, actual double, pred double")


def test_stream_gives_the_batch_intervals(spark, tmp_path):
    df = series(spark)
    df.filter("ts < '2024-01-03'").repartition(1).write.parquet(str(tmp_path / "in" / "a"))
    df.filter("ts >= '2024-01-03'").repartition(1).write.parquet(str(tmp_path / "in" / "b"))
    feed = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = online.conformal_stream(feed, "zone", window=48, bias_days=2.0).writeStream.outputMode("append").format("memory").queryName("bands").trigger(availableNow=True).start()
    running.awaitTermination(180)
    got = sorted(map(tuple, spark.table("bands").collect()))
    want = sorted(map(tuple, online.conformal_intervals(df, "zone", window=48, bias_days=2.0).collect()))
    assert len(got) == 240 and [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(a - b) < 1e-9 for g, w in zip(got, want) for a, b in zip(g[2:4], w[2:4]))


def test_bundle_and_odd_rows(spark):
    df = series(spark, 40)
    got = {r["zone"]: r for r in online.conformal_state(df, ["zone"], window=20, warm=14).collect()}
    for zone, r in got.items():
        plain = online.Conformal(0.9, 20, 14)
        for x in df.filter(df["zone"] == zone).orderBy("ts").collect():
            plain.learn(x["pred"], x["actual"])
        assert (r["n"], r["warmed"]) == (40, True) and abs(r["half_width"] - plain.half_width()) < 1e-12 and 0 <= r["entropy"] <= math.log2(15)
    assert online.conformal_intervals(df.limit(0), "zone").count() == 0
    odd = spark.createDataFrame([(None, None, 1.0, 2.0), ("z", None, None, 1.0), ("z", datetime.datetime(2024, 1, 1), 1.0, None), ("z", datetime.datetime(2024, 1, 1), 2.0, 2.0), ("z", datetime.datetime(2024, 1, 1), 2.0, 2.0)], df.schema)
    assert sorted((r["zone"] or "", r["hit"]) for r in online.conformal_intervals(odd, "zone").collect() if r["hit"] is not None) == [("", False), ("z", True), ("z", True)]
    assert sorted((r["zone"] or "", r["n"]) for r in online.bias_fold(odd, ["zone"]).collect()) == [("", 1), ("z", 2)]
    assert [r["n"] for r in online.bias_fold(odd.limit(0), ["zone"]).collect()] == []


def test_smoothed_keeps_the_last_over_nulls(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(hours=i), v) for i, v in enumerate([None, 1.0, None, 2.0])]
    out = online.smoothed(spark.createDataFrame(rows, "zone string, ts timestamp, k double"), ["zone"], "k", 0.3).orderBy("ts").collect()
    assert [r["smooth"] for r in out] == [None, 1.0, 1.0, 0.7 * 1.0 + 0.3 * 2.0]


def test_one_rate_is_plain_adaptive_conformal(spark):
    df = series(spark, 60, ("a",))
    got = [(r["lower"], r["upper"]) for r in online.conformal_intervals(df, "zone", rates=[0.05], warm=5).orderBy("ts").collect()]
    level, scores = 0.1, []
    for r, (lower, upper) in zip(df.orderBy("ts").collect(), got, strict=True):
        half = quantile(scores, 1 - level) if len(scores) >= 5 else 0.0
        assert abs(lower - (r["pred"] - half)) < 1e-9 and abs(upper - (r["pred"] + half)) < 1e-9
        score = abs(r["actual"] - r["pred"])
        level = max(1e-6, min(1 - 1e-6, level + 0.05 * (0.1 - (score > (quantile(scores, 1 - level) if scores else 0.0)))))
        scores.append(score)


def test_streams_pass_over_nulls_and_take_late_hours_when_they_come(spark, tmp_path):
    """A null spoils nothing: both streams give what the walks give for the same rows in the order in which they came."""
    start = datetime.datetime(2024, 1, 1)
    random.seed(12)
    rows = [("a", start + datetime.timedelta(hours=i), None if i in (3, 30) else random.gauss(10, 3), None if i in (7, 50) else 9.0) for i in range(60)]
    late, batches = rows.pop(20), []
    batches = [rows[:40], [late, *rows[40:]]]
    schema = "zone string, ts timestamp, actual double, pred double"
    for number, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    arrived = spark.createDataFrame([(*r, n) for n, r in enumerate([*batches[0], *sorted(batches[1], key=lambda r: r[1])])], schema + ", n int")
    in_order = arrived.withColumn("told", arrived["ts"]).withColumn("ts", F.timestamp_seconds("n"))
    feed = lambda: spark.readStream.schema(schema.replace(", n int", "")).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, stream in (("nulls_bias", online.bias_stream(feed(), "zone")), ("nulls_bands", online.conformal_stream(feed(), "zone", window=30, warm=5))):
        running = stream.writeStream.outputMode("update" if name == "nulls_bias" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        running.awaitTermination(180)
    last = max(spark.table("nulls_bias").collect(), key=lambda r: r["n"])
    want = online.bias_fold(in_order, ["zone"]).first()
    assert last["n"] == want["n"] == 56 and abs(last["bias"] - want["bias"]) < 1e-9 and abs(last["spread"] - want["spread"]) < 1e-9
    told = {r["n"]: r["told"] for r in in_order.collect()}
    got = {r["ts"]: (r["lower"], r["upper"], r["hit"]) for r in spark.table("nulls_bands").collect()}
    plain = {told[int((r["ts"] - datetime.datetime(1970, 1, 1)).total_seconds())]: (r["lower"], r["upper"], r["hit"]) for r in online.conformal_intervals(in_order, "zone", window=30, warm=5).collect()}
    assert got.keys() == plain.keys() and len(got) == 58 and sum(v[2] is None for v in got.values()) == 2
    assert all(abs(a - b) < 1e-9 for t in got for a, b in zip(got[t][:2], plain[t][:2])) and all(got[t][2] == plain[t][2] for t in got)


def test_alarm_after_a_drift(spark, larger_dir):
    """The learner undercovers once errors grow, and not before: alarms come behind the middle of the time."""
    from gridloom.plans import catalog

    middle = datetime.datetime(2024, 1, 16)
    found = catalog.QUERIES["drift_alarm"](spark, larger_dir).collect()
    behind = [r for r in found if r["alarm"] > middle]
    assert {r["zone"] for r in behind} and all(r["hours"] >= 24 for r in found) and len(behind) > len(found) / 2


def test_prices_below_zero_are_spread(spark):
    from gridloom.operators import panels

    df = spark.createDataFrame([(str(i), v) for i in range(300) for v in (-40.0, 40.0, 0.0)], "k string, v double")
    out = df.select("v", panels.spread(F.col("v"), F.lit(0.3), F.col("k"), below=True).alias("x"), panels.spread(F.col("v"), F.lit(0.3), F.col("k")).alias("y")).toPandas()
    assert (out["x"][out["v"] < 0] < 0).all() and out["x"][out["v"] < 0].std() > 5 and (out["y"][out["v"] < 0] == -40).all() and (out["x"][out["v"] == 0] == 0).all()
