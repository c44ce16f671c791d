"""As-of joins cut in ranges of time against plain searches, and what was known when."""

import datetime
import random

from pyspark.sql import functions as F

from gridloom.operators import align

START = datetime.datetime(2024, 1, 1)
MINUTE = datetime.timedelta(minutes=1)


def test_one_key_over_many_ranges(spark):
    random.seed(7)
    at = lambda: START + random.randrange(60 * 24 * 90) * MINUTE
    left = [("a" if random.random() < 0.9 else None, at(), i) for i in range(900)] + [("a", None, 901), ("b", at(), 902)]
    right = [("a" if random.random() < 0.9 else None, at(), None if random.random() < 0.2 else random.random(), i % 7) for i in range(60)] + [("a", None, 5.0, 1)]
    x, y = spark.createDataFrame(left, "zone string, ts timestamp, i int"), spark.createDataFrame(right, "zone string, ts timestamp, v double, tie int")
    out = align.as_of(x, y, ["zone"], "v", "tie", 24)
    want = {i: max(((t, tie, v) for z, t, v, tie in right if z == zone and ts and t and t <= ts and v is not None), default=(0, 0, None))[2] for zone, ts, i in left}
    assert {r["i"]: r["v"] for r in out.collect()} == want
    # the rows of the one key lie in many tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = out.filter("zone = 'a'").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fill_over_ranges_without_values(spark):
    rows = [("a", START, 1.0), ("a", START + 300 * 60 * MINUTE, None), ("a", START + 500 * 60 * MINUTE, 2.0), ("a", START + 700 * 60 * MINUTE, 3.0)]
    out = {r["ts"]: r["v"] for r in align.forward_fill(spark.createDataFrame(rows, "zone string, ts timestamp, v double"), ["zone"], "v", 48).collect()}
    assert len(out) == 701 and all(v == (1.0 if t < START + 500 * 60 * MINUTE else 2.0 if t < START + 700 * 60 * MINUTE else 3.0) for t, v in out.items())


def facts():
    random.seed(9)
    hour = lambda h: START + h * 60 * MINUTE
    return [("z", hour(h), hour(h) + random.randrange(-600, 6000) * MINUTE, None if random.random() < 0.1 else float(100 * h + k), k) for h in range(150) for k in range(3)]


def test_only_what_had_been_told(spark):
    told, schema = facts(), "zone string, ts timestamp, told timestamp, v double, k int"
    asked = [("z", START + h * 60 * MINUTE, START + (h + d) * 60 * MINUTE) for h in range(0, 150, 3) for d in (-9, 0, 12, 90)] + [("z", None, START), ("z", START, None)]
    wanted = spark.createDataFrame(asked, "zone string, ts timestamp, origin timestamp")
    got = {(r["ts"], r["origin"]): r["v"] for r in align.revision_at(wanted, spark.createDataFrame(told, schema), ["zone"], "v", "k", 24).collect()}
    plain = lambda rows, ts, o: max(((t, k, v) for _, s, t, v, k in rows if s == ts and o and t <= o and v is not None), default=(0, 0, None))[2]
    assert got == {(ts, o): plain(told, ts, o) for _, ts, o in asked}
    newest = align.newest_at(wanted.select("zone", "origin").distinct(), spark.createDataFrame(told, schema), ["zone"], "v", "k", 24).collect()
    for r in newest:
        best = max(((s, t, k, v) for _, s, t, v, k in told if r["origin"] and t <= r["origin"] and v is not None), default=(None, 0, 0, None))
        assert (r["newest"], r["v"]) == (best[0], best[3])
    # a revision planted later changes no earlier origin's row
    late = [*told, *(("z", s, datetime.datetime(2024, 2, 20), -1.0, 9) for _, s, *_ in told)]
    again = {(r["ts"], r["origin"]): r["v"] for r in align.revision_at(wanted, spark.createDataFrame(late, schema), ["zone"], "v", "k", 24).collect()}
    assert again == got
    assert align.revision_at(wanted.limit(0), spark.createDataFrame(told, schema), ["zone"], "v", "k").count() == 0
    assert align.newest_at(wanted.select("zone", "origin"), spark.createDataFrame([], schema), ["zone"], "v", "k").filter("newest is not null").count() == 0
