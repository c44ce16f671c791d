"""Reconciliation: a plain walk, the batch walk and the stream agree under shuffled batches, nulls, late rows and a restart."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import reconcile

SCHEMA = "zone string, told long, kind string, ts long, value double, model string"
H, T0 = 3600, 1_704_067_200


def tellings(seed=3, hours=400):
    random.seed(seed)
    rows = []
    for zone in ("a", "b"):
        for h in range(hours):
            ts = T0 + h * H
            model = "one" if h < 250 else "two"
            for lead in (30, 6):
                rows.append((zone, ts - lead * H + random.randrange(600), "forecast", ts, 50 + 10 * random.random(), model))
            actual = None if random.random() < 0.05 else 55 + 8 * random.random()
            rows.append((zone, ts + random.choice([-H, 1, 5, 300, 350]) * H, "actual", ts, actual, None))
            if random.random() < 0.1:
                rows.append((zone, ts + 400 * H, "actual", ts, 1.0, None))
    rows += [("a", None, "actual", T0, 1.0, None), ("a", T0, None, T0, 1.0, None), ("a", T0, "actual", None, 1.0, None), (None, T0 - H, "forecast", T0 + 5, 2.0, None), (None, T0 + H, "actual", T0 + 5, 3.0, None)]
    return rows


def plain(rows):
    """By hand: pairs in order of told, and what the calibrators say of them."""
    out, zones = [], {}
    for zone, told, kind, ts, value, model in sorted((r for r in rows if None not in r[1:5]), key=lambda r: r[1:5]):
        waiting, met, cal = zones.setdefault(zone, ({}, set(), reconcile.Calibrators(interval_warm=10)))
        if kind == "forecast" and ts > told and ts not in met:
            waiting[ts] = (value, model)
        elif kind == "actual" and ts in waiting and ts not in met and told - ts <= 14 * 86_400:
            met.add(ts)
            out.append((zone, *cal.pair(ts, told, waiting[ts][0], value, waiting[ts][1])))
    return out


MAKE = lambda: reconcile.Calibrators(interval_warm=10)


def close(got, want):
    key = lambda r: (r[0] or "", r[2], r[1])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[-2:] == b[-2:] and a[3:9] == pytest.approx(b[3:9])


def test_walk_against_a_plain_one(spark):
    rows = tellings()
    want = plain(rows)
    got = reconcile.reconciled_walk(spark.createDataFrame(rows, SCHEMA).repartition(5), ["zone"], make=MAKE).collect()
    close(got, want)
    assert len(want) > 400 and any(r[1] - r[2] <= -300 * H for r in want)  # late actuals are among them
    starts = [r for r in want if r[0] == "a" and r[-1] == "two" and r[9] == 0]
    assert starts and min(starts, key=lambda r: r[2])[8] == 0.0  # the other model starts anew
    assert reconcile.reconciled_walk(spark.createDataFrame([], SCHEMA), ["zone"]).count() == 0


def test_stream_gives_the_walks_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [r for r in tellings(5, 120) if r[0] is not None]
    early, late = [r for r in rows if r[1] is None or r[1] < T0 + 60 * H], [r for r in rows if r[1] is not None and r[1] >= T0 + 60 * H]
    seeds = reconcile.learned_walk(reconcile.reconciled_walk(spark.createDataFrame(tellings(8, 60), SCHEMA), ["zone"], make=MAKE), ["zone"], make=MAKE).filter("zone is not null")
    seeds.write.parquet(f"{tmp_path}/seeds")
    seeds = spark.read.parquet(f"{tmp_path}/seeds")
    df = lambda r: spark.createDataFrame(r, SCHEMA).withColumn("at", F.timestamp_seconds("told"))
    try:
        for number, part in enumerate((early, late)):
            random.shuffle(part)  # within the delay rows come in any order
            for k in range(2):
                df(part[k::2]).coalesce(1).write.parquet(f"{tmp_path}/in/{number}{k}")
            df([(z, T0 + (60 if not number else 9000) * H + 900 * H, "tick", T0, 0.0, None) for z in ("a", "b")][: 2 * number]).coalesce(1).write.parquet(f"{tmp_path}/in/{number}9")
            feed = spark.readStream.schema(df([]).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            told = reconcile.reconciled_stream(feed, ["zone"], "3000 hours", seeds, MAKE)
            run = told.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            run.awaitTermination(300)
            assert run.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = reconcile.reconciled_walk(spark.createDataFrame(rows, SCHEMA), ["zone"], seeds, MAKE).collect()
    assert len(want) > 100
    close(spark.read.parquet(f"{tmp_path}/out").collect(), list(map(tuple, want)))


def test_learned_state_goes_on(spark):
    rows = [r for r in tellings(6, 100) if r[0] == "a"]
    whole = spark.createDataFrame(rows, SCHEMA)
    pairs = reconcile.reconciled_walk(whole, ["zone"], make=MAKE)
    cut = T0 + 50 * H
    first = reconcile.learned_walk(pairs.filter(F.col("told") < cut), ["zone"], make=MAKE)
    again = reconcile.learned_walk(pairs.filter(F.col("told") >= cut), ["zone"], first, MAKE).first()
    once = reconcile.learned_walk(pairs, ["zone"], make=MAKE).first()
    assert again["n"] == once["n"] and again["bias"] == pytest.approx(once["bias"]) and again["scores"] == pytest.approx(once["scores"]) and again["seen"] == once["seen"]
    assert datetime.datetime.fromtimestamp(cut, datetime.UTC).year == 2024
