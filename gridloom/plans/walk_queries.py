"""Queries on walk-forward refits, replays, horizons, and what was known when."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import physics
from gridloom.operators import walkforward
from gridloom.operators.walkforward import Bin, Model
from gridloom.plans.base import query, r
from gridloom.session import table

_START, _FROZEN, _FLOOR = "1996-01-01", "1998-01-01", 60.0
_BINS = (Bin(F.weekday, 7), Bin(lambda ts: F.weekofyear(ts) - 1, 53))
_MODEL = Model("y", (("y", 7), ("x", 7)), _BINS, lambda ts: F.trunc(ts, "month"), "1 day")


def daily_orders(spark, sf_dir):
    """ts, y, x: each day's mean order in thousands, and its number of orders."""
    rows = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").cast("timestamp").alias("ts"))
    return rows.agg((F.avg("o_totalprice") / 1000).alias("y"), F.count("*").cast("double").alias("x"))


def _refits(features: list[tuple[str, int]], months: str) -> str:
    """CTEs that refit the model for each row of a table of months (m) from its training rows: season parts, two-feature ridge, errors."""
    (a, la), (b, lb) = features
    return f"""-- refits
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 1000 AS y, count(*)::DOUBLE AS x FROM orders GROUP BY 1),
w AS (SELECT day, y, x, isodow(day) AS wd, weekofyear(day) AS wk, CAST(date_trunc('month', day) AS DATE) AS month FROM d),
mo AS ({months}),
t AS (SELECT m, w.* FROM mo JOIN w ON w.day < m),
h AS (SELECT m, wd, avg(y) AS hy, avg(x) AS hx FROM t GROUP BY 1, 2),
k AS (SELECT t.m, wk, avg(y - hy) AS ky, avg(x - hx) AS kx FROM t JOIN h ON h.m = t.m AND h.wd = t.wd GROUP BY 1, 2),
s AS (SELECT mo.m, w.day, w.month, w.y, w.x, coalesce(hy, 0) + coalesce(ky, 0) AS sy, coalesce(hx, 0) + coalesce(kx, 0) AS sx FROM mo CROSS JOIN w LEFT JOIN h ON h.m = mo.m AND h.wd = w.wd LEFT JOIN k ON k.m = mo.m AND k.wk = w.wk),
f AS (SELECT s.m, s.day, s.month, s.y, s.sy, s.y - s.sy AS e, a.{a} - a.s{a} AS p, b.{b} - b.s{b} AS q FROM s LEFT JOIN s a ON a.m = s.m AND a.day = s.day - {la} LEFT JOIN s b ON b.m = s.m AND b.day = s.day - {lb}),
g AS (SELECT f.* , l.e AS e1, l.p AS p1, l.q AS q1 FROM f LEFT JOIN f l ON l.m = f.m AND l.day = f.day - 1),
c AS (SELECT m, count(*) AS n, avg(p) AS mp, avg(q) AS mq, avg(e) AS me, sum(p * p) - count(*) * avg(p) * avg(p) + 1 AS pp, sum(q * q) - count(*) * avg(q) * avg(q) + 1 AS qq, sum(p * q) - count(*) * avg(p) * avg(q) AS pq, sum(p * e) - count(*) * avg(p) * avg(e) AS pe, sum(q * e) - count(*) * avg(q) * avg(e) AS qe
      FROM g WHERE day < m AND p IS NOT NULL AND q IS NOT NULL AND e IS NOT NULL AND p1 IS NOT NULL AND q1 IS NOT NULL AND e1 IS NOT NULL GROUP BY m HAVING count(*) >= 30),
b AS (SELECT m, n, (qq * pe - pq * qe) / (pp * qq - pq * pq) AS bp, (pp * qe - pq * pe) / (pp * qq - pq * pq) AS bq, me - mp * (qq * pe - pq * qe) / (pp * qq - pq * pq) - mq * (pp * qe - pq * pe) / (pp * qq - pq * pq) AS b0 FROM c),
v AS (SELECT g.m, g.day, g.month, g.y, n, sy, b0, bp * coalesce(p, 0) AS lp, bq * coalesce(q, 0) AS lq, e - b0 - bp * p - bq * q AS u, e1 - b0 - bp * p1 - bq * q1 AS u1, p1 IS NOT NULL AND q1 IS NOT NULL AND e1 IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL AND e IS NOT NULL AS whole FROM g JOIN b ON b.m = g.m),
phi AS (SELECT m, greatest(least(sum(u * u1) / sum(u1 * u1), 0.99), -0.99) AS phi FROM v WHERE day < m AND whole GROUP BY m)
"""


_MONTHS = f"SELECT DISTINCT month AS m FROM w WHERE month >= DATE '{_START}'"


@query(
    "monthly_walk_forward",
    _refits([("y", 7), ("x", 7)], _MONTHS)
    + f"SELECT CAST(v.day AS TIMESTAMP) AS ts, n, round(y + 1e-9, 4) AS actual, round(sy + 1e-9, 4) AS season, round(greatest(sy + b0 + lp + lq, {_FLOOR}) + 1e-9, 4) AS pred, round(phi, 4) + 0.0 AS phi FROM v JOIN phi ON phi.m = v.m WHERE v.month = v.m",
)
def monthly_walk_forward(spark, sf_dir):
    """Each day by the model of all days before its month: seasonal parts by weekday and week, and a ridge on last week's remainders."""
    out = walkforward.walk_forward(daily_orders(spark, sf_dir), [], _MODEL).filter(F.col("period") >= _START)
    pred = F.greatest(F.col("season") + F.col("linear"), F.lit(_FLOOR))
    return out.select("ts", "n", r(F.col("actual") + 1e-9, 4).alias("actual"), r(F.col("season") + 1e-9, 4).alias("season"), r(pred + 1e-9, 4).alias("pred"), r("phi", 4).alias("phi"))


@query(
    "production_replay",
    _refits([("y", 7), ("x", 7)], f"SELECT DATE '{_FROZEN}' AS m")
    + f"SELECT CAST(day AS TIMESTAMP) AS ts, round(y + 1e-9, 4) AS actual, round({_FLOOR} + greatest(sy + b0 + lq - {_FLOOR}, 0) + ln(1 + exp(-abs(sy + b0 + lq - {_FLOOR}))), 4) AS pred FROM v WHERE day >= m",
)
def production_replay(spark, sf_dir):
    """Every day from 1998 on by one frozen model, as it is served: its own lag isn't fed, and a soft floor holds it."""
    frozen = F.lit(_FROZEN).cast("timestamp")
    out = walkforward.replay(daily_orders(spark, sf_dir), [], _MODEL, frozen, zeroed=(("y", 7),))
    return out.select("ts", r(F.col("actual") + 1e-9, 4).alias("actual"), r(physics.soft_floor(F.col("season") + F.col("linear"), _FLOOR), 4).alias("pred"))


_LEADS = [1, 2, 3, 7]
_HONEST = _refits([("y", 7), ("x", 1)], _MONTHS) + f"""
SELECT CAST(lead AS INTEGER) AS lead, count(*) AS n, round(avg(abs(pred - y)), 4) AS mae, round(avg(pred - y), 4) + 0.0 AS bias FROM (
  SELECT o.lead, t.y, t.sy + t.b0 + t.lp + CASE WHEN o.lead <= 1 THEN t.lq ELSE 0 END + pow(phi, o.lead) * o.u AS pred
  FROM (SELECT m, day, month, coalesce(y - sy - b0 - lp - lq, 0) AS u, unnest({_LEADS}) AS lead FROM v WHERE month = m) o JOIN v t ON t.m = o.m AND t.day = o.day + CAST(o.lead AS INTEGER) JOIN phi ON phi.m = o.m) GROUP BY 1"""


@query("horizon_backtest", _HONEST)
def horizon_backtest(spark, sf_dir):
    """Forecasts from every day for 1, 2, 3 and 7 days ahead, by the model and the values known there; errors by lead."""
    model = Model("y", (("y", 7), ("x", 1)), _BINS, _MODEL.period, "1 day")
    out = walkforward.horizon(daily_orders(spark, sf_dir), [], model, F.col("ts") >= _START, _LEADS)
    error = F.col("pred") - F.col("actual")
    return out.groupBy("lead").agg(F.count("*").alias("n"), r(F.avg(F.abs(error)), 4).alias("mae"), r(F.avg(error), 4).alias("bias"))


_TOLD = """-- told
WITH f AS (SELECT event_type AS zone, date_trunc('hour', ts) AS ts, ts AS told, value, event_id FROM events),
o AS (SELECT DISTINCT event_type AS zone, date_trunc('day', ts) + INTERVAL 6 HOUR AS origin FROM events), w AS (SELECT zone, origin, lead, origin + lead * INTERVAL 1 HOUR - INTERVAL 24 HOUR AS ts FROM o, (SELECT unnest([1, 12, 24, 36]) AS lead)),
p AS (SELECT w.zone, w.origin, w.lead, arg_max(f.value, (f.told, f.event_id)) AS past FROM w JOIN f ON f.zone = w.zone AND f.ts = w.ts AND f.told <= w.origin GROUP BY 1, 2, 3),
n AS (SELECT o.zone, o.origin, max(f.ts) AS newest, arg_max(f.value, (f.ts, f.told, f.event_id)) AS last FROM o JOIN f ON f.zone = o.zone AND f.told <= o.origin GROUP BY 1, 2)
SELECT w.zone, w.origin, CAST(w.lead AS INTEGER) AS lead, round(past, 6) AS past, newest, round(last, 6) AS last FROM w LEFT JOIN p ON p.zone = w.zone AND p.origin = w.origin AND p.lead = w.lead LEFT JOIN n ON n.zone = w.zone AND n.origin = w.origin"""


@query("known_features", _TOLD)
def known_features(spark, sf_dir):
    """Features of forecasts made at 6 o'clock for several hours ahead, from events as revisions of their hour: what had been told by then of the
    hour a day before the target (nothing, where that hour was still to come), and of the newest hour told of."""
    from gridloom.operators import align

    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.col("ts").cast("timestamp").alias("told"), "value", "event_id")
    origins = events.select("zone", (F.date_trunc("day", "told") + F.expr("interval 6 hours")).alias("origin")).distinct()
    asked = origins.select("zone", "origin", F.explode(F.array(*map(F.lit, [1, 12, 24, 36]))).alias("lead"))
    asked = asked.withColumn("ts", F.col("origin") + (F.col("lead") - 24) * F.expr("interval 1 hour"))
    past = align.revision_at(asked, events, ["zone"], "value", "event_id", 72).withColumnRenamed("value", "past")
    newest = align.newest_at(origins, events, ["zone"], "value", "event_id", 72).withColumnRenamed("value", "last")
    return past.join(newest, ["zone", "origin"]).select("zone", "origin", "lead", r("past").alias("past"), "newest", r("last").alias("last"))


@query("quantile_boost")
def quantile_boost(spark, sf_dir):
    """Forecasts of three quantiles of each zone's hour by boosted trees on the day before, the hour and the weekday, learned from the days up to the
    20th of a month; held against a plain version in the tests."""
    from gridloom.operators import align, boosting
    from gridloom.plans.base import zonal

    rows = align.time_lag(zonal(spark, sf_dir), ["zone"], "p", 24, "before").withColumns({"hour": F.hour("ts"), "weekday": F.weekday("ts")})
    model = boosting.quantile_boost(rows.filter(F.dayofmonth("ts") <= 20), "p", ["before", "hour", "weekday"], [0.1, 0.5, 0.9], trees=8)
    return model.predicted(rows).select("zone", "ts", "p", *[r(q).alias(q) for q in ("q10", "q50", "q90")])


@query(
    "committed_merge",
    ", m AS (SELECT ts, CASE WHEN day(ts) >= 15 THEN 2 * p ELSE p END AS p FROM hourly UNION ALL SELECT ts + INTERVAL 31 DAY, p FROM hourly WHERE day(ts) < 15) SELECT ts, round(p, 6) AS p, CAST(2 AS BIGINT) AS version FROM m",
)
def committed_merge(spark, sf_dir):
    """Hourly prices and their copies a month on, merged in two commits: the second corrects the hours from the 15th and leaves the other month as it is."""
    import uuid

    from gridloom.plans.base import hourly
    from gridloom.session import shared_folder
    from gridloom.sources.commits import CommittedTable

    h = hourly(spark, sf_dir)
    store = CommittedTable(spark, f"{shared_folder(spark)}/committed-{uuid.uuid4().hex}", ["ts"])
    store.merge(h.unionByName(h.filter(F.dayofmonth("ts") < 15).withColumn("ts", F.col("ts") + F.expr("interval 31 days"))))
    number = store.merge(h.filter(F.dayofmonth("ts") >= 15).withColumn("p", 2 * F.col("p")))
    return store.load().select("ts", r("p").alias("p"), F.lit(number).cast("long").alias("version"))


@query("reconciled_pairs")
def reconciled_pairs(spark, sf_dir):
    """Each zone's forecasts (the day before's price, told 12 and 6 hours ahead) meet actuals, of which every fifth comes a day late; held against a plain
    walk and the stream in the tests."""
    from gridloom.operators import align
    from gridloom.plans.base import zonal
    from gridloom.streaming import reconcile

    z = align.time_lag(zonal(spark, sf_dir), ["zone"], "p", 24, "pred").withColumn("s", F.unix_timestamp("ts"))
    model = F.when(F.dayofmonth("ts") < 20, "one").otherwise("two")
    told = [F.struct((F.col("s") - lead * 3600).alias("told"), F.lit("forecast").alias("kind"), (F.col("pred") + lead / 10).alias("value"), model.alias("model")) for lead in (12, 6)]
    late = F.when(F.pmod(F.xxhash64("zone", "s"), F.lit(5)) == 0, 86_400).otherwise(600)
    told.append(F.struct((F.col("s") + late).alias("told"), F.lit("actual").alias("kind"), F.col("p").alias("value"), F.lit(None).cast("string").alias("model")))
    rows = z.select("zone", F.col("s").alias("ts"), F.explode(F.array(*told)).alias("t")).select("zone", "ts", "t.*")
    out = reconcile.reconciled_walk(rows, ["zone"])
    return out.select("zone", "ts", "told", "model", "n", *[r(c).alias(c) for c in ("forecast", "corrected", "lower", "upper", "actual")])
