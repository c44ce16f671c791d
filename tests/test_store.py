"""Store, readers and versioned states on small tables and files."""

import datetime
import json

from pyspark.sql import functions as F

from gridloom.sources import readers, store

HOUR = datetime.timedelta(hours=1)
START = datetime.datetime(2024, 1, 1)


def test_merge_keeps_the_fresh_row_and_fills_nulls(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (None, 9.0, "n")], "k int, x double, y string")
    new = spark.createDataFrame([(2, None, "b"), (3, 3.0, "c"), (3, 4.0, "c")], "k int, x double, y string")
    plain = {r["k"]: (r["x"], r["y"]) for r in store.merged(old, new, ["k"]).collect()}
    assert plain == {1: (1.0, "a"), 2: (None, "b"), 3: (4.0, "c"), None: (9.0, "n")}
    filled = {r["k"]: (r["x"], r["y"]) for r in store.merged(old, new, ["k"], fill=True).collect()}
    assert filled[2] == (2.0, "b")
    assert store.merged(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_content_hash_tells_rows_and_not_their_order(spark):
    rows = [(i % 7, f"t{i % 5}", None if i % 11 == 0 else i) for i in range(300)]
    tell = lambda r: spark.createDataFrame(r, "a int, b string, c int").repartition(5).agg(store.content_hash(store.row_text(["a", "b", "c"])).alias("h")).first()["h"]
    assert tell(rows) == tell(rows[::-1]) and len(tell(rows)) == 16
    assert tell(rows) != tell(rows[:-1]) and tell(rows) != tell([*rows, rows[0]]) and tell([(1, "", 1)]) != tell([(1, None, 1)])


def test_versions_upsert_and_log(spark, tmp_path):
    path = str(tmp_path / "prices")
    assert store.load(spark, path) is None
    hours = lambda a, b, x: spark.createDataFrame([(START + i * HOUR, float(x)) for i in range(a, b)], "ts timestamp, p double")
    assert store.upsert(hours(0, 48, 1), path, ["ts"]) == 1
    assert store.upsert(hours(40, 60, 2), path, ["ts"], days=1) == 2
    rows = {r["ts"]: r["p"] for r in store.load(spark, path).collect()}
    assert min(rows) == START + 35 * HOUR and max(rows) == START + 59 * HOUR and rows[START + 39 * HOUR] == 1.0 and rows[START + 40 * HOUR] == 2.0
    assert store.load(spark, path, 1).count() == 48 and store.versions(spark, path) == [1, 2]
    (tmp_path / "prices" / "version=3").mkdir()  # a write that didn't end
    assert store.load(spark, path).count() == len(rows)
    assert store.upsert(hours(60, 61, 3), path, ["ts"]) == 4 and store.versions(spark, path) == [1, 2, 4]  # nor does it stop the next one
    for n in (1, 2):
        store.append_log(spark.createDataFrame([(n, "x")], "rows int, name string"), str(tmp_path / "log"))
    assert sorted(r["rows"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]


def test_states_of_another_model_are_dropped(spark):
    model = spark.createDataFrame([("a", 1.0), ("b", 0.1 + 0.2)], "feature string, coef double")
    one = store.fingerprint(model, "feature", "coef").first()["fingerprint"]
    same = store.fingerprint(model.orderBy(F.desc("feature")).withColumn("coef", F.round("coef", 11)), "feature", "coef").first()["fingerprint"]
    assert one == same and len(one) == 16
    states = spark.createDataFrame([(one, 1), ("old", 2)], "fingerprint string, n int")
    assert [r["n"] for r in store.valid_states(states, store.fingerprint(model, "feature", "coef")).collect()] == [1]


def test_meter_export(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Point;Product;Resolution;Unit;Reading;Start;Amount;Quality\n" + "\n".join(["1;8;PT15M;kWh;x;2024-01-01T00:00:00Z;0,25;OK", "1;8;PT15M;kWh;x;2024-01-01T00:15:00Z;0,50;EST", "1;8;PT1H;kWh;x;2024-01-01T02:00:00+01:00;1;OK", "1;8;PT1H;kWh;x;;7;OK", "1;8;PT1H;kWh;x;2024-01-01T03:00:00Z;bad;OK"]) + "\n", encoding="utf-8")
    got = {r["ts"].hour: r["kwh"] for r in readers.meter_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {0: 0.75, 1: 1.0}
    assert {r["ts"].hour: r["kwh"] for r in readers.meter_csv(spark, str(tmp_path / "m.csv"), estimated=False).collect()} == {0: 0.25, 1: 1.0}


def test_reservoirs_and_artefacts(spark, tmp_path):
    report = {"currentYear": [{"year": 2024, "week": 2, "total": 60.0, "no1": 50.0}, {"year": 2023, "week": 2, "total": 40.0}, {"year": "x", "week": 1}, {"week": 5}]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    weeks = readers.reservoir_weeks(spark, str(tmp_path / "r.json"))
    got = {r["year"]: (r["week"], r["total"], r["zones"], r["offset"]) for r in readers.week_offsets(weeks).collect()}
    assert got == {2024: (2, 60.0, {"no1": 50.0}, 10.0), 2023: (2, 40.0, {}, -10.0)}
    (tmp_path / "m.json").write_text(json.dumps({"intercept": 1.5, "features": [{"name": "a", "coef": -2}, {"name": "b"}]}))
    assert {r["feature"]: r["coef"] for r in readers.coefficients(spark, str(tmp_path / "m.json")).collect()} == {"intercept": 1.5, "a": -2.0, "b": 0.0}
    (tmp_path / "bad.json").write_text("{no model")
    for path in ("bad.json", "missing.json"):
        assert [tuple(r) for r in readers.coefficients(spark, str(tmp_path / path)).collect()] == [("intercept", 0.0)]
    (tmp_path / "s.json").write_text(json.dumps({"components": {"fi": {"P_hour": [1.0, 2.0], "P_week": [3.0]}}}))
    assert sorted(map(tuple, readers.seasonal_parts(spark, str(tmp_path / "s.json")).collect())) == [("fi", "hour", 0, 1.0), ("fi", "hour", 1, 2.0), ("fi", "week", 0, 3.0)]


def test_odd_times_and_meters(spark):
    texts = ["2024-01-01 05:00:00", "2024-01-01T05:00:00Z", "2024-01-01T07:00:00+02:00", "1704085200", "12", "no time", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(readers.coerced(F.col("t")).alias("at")).collect()
    assert [r["at"] for r in rows] == [datetime.datetime(2024, 1, 1, 5)] * 4 + [None] * 4
    counter = spark.createDataFrame([("a", START, 5.0), ("a", START + 24 * HOUR, None), ("a", START + 48 * HOUR, 33.0), ("b", START, 9.0), ("b", START + HOUR, 1.0)], "m string, ts timestamp, v double")
    assert {r["m"]: r["daily"] for r in readers.counter_daily(counter, ["m"], "v", 14).collect()} == {"a": 2.0, "b": None}
