"""Queries on online learners, bands, verification and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import align, curves, verify
from gridloom.plans.base import days, hourly, pairs, query, r, zonal
from gridloom.streaming import online


def zone_pairs(spark, sf_dir):
    """zone, ts, actual, pred: each zone's hours with the price a day before."""
    return align.time_lag(zonal(spark, sf_dir), ["zone"], "p", 24, "pred").filter("pred is not null").withColumnRenamed("p", "actual")


_WALK = """, e AS (SELECT ts, hour(ts) AS h, actual, pred, actual - pred AS e, row_number() OVER (PARTITION BY hour(ts) ORDER BY ts) AS n FROM pairs),
f AS (WITH RECURSIVE f AS (SELECT h, n, e AS bias, abs(e) AS spread FROM e WHERE n = 1
 UNION ALL SELECT e.h, e.n, (1 - k) * f.bias + k * c, (1 - k) * f.spread + k * abs(c) FROM f JOIN e ON e.h = f.h AND e.n = f.n + 1,
 LATERAL (SELECT greatest(1.0 / e.n, 1 - pow(0.5, 1.0 / 3)) AS k, CASE WHEN e.n > 3 AND f.spread > 0 THEN greatest(least(e.e, 5 * f.spread), -5 * f.spread) ELSE e.e END AS c)) SELECT * FROM f)
"""


@query("bias_per_hour", _WALK + "SELECT CAST(h AS BIGINT) AS hour, round(arg_max(bias, n), 6) + 0.0 AS bias, round(arg_max(spread, n), 6) AS spread, max(n) AS n FROM f GROUP BY h")
def bias_per_hour(spark, sf_dir):
    """The bias of each hour of the day as an online mean."""
    rows = pairs(spark, sf_dir).withColumn("hour", F.hour("ts").cast("long"))
    return online.bias_fold(rows, ["hour"]).select("hour", r("bias").alias("bias"), r("spread").alias("spread"), "n")


@query(
    "bias_walk",
    _WALK + "SELECT CAST(e.h AS BIGINT) AS hour, e.ts, round(e.pred + CASE WHEN e.n > 3 THEN f.bias ELSE 0 END, 6) AS corrected, round(coalesce(f.bias, 0), 6) + 0.0 AS bias FROM e LEFT JOIN f ON f.h = e.h AND f.n = e.n - 1",
)
def bias_walk(spark, sf_dir):
    """Each forecast corrected by its hour's bias so far (from the fourth on), then learned from."""
    rows = pairs(spark, sf_dir).withColumn("hour", F.hour("ts").cast("long"))
    return online.bias_walk(rows, ["hour"]).select("hour", "ts", r("corrected").alias("corrected"), r("bias").alias("bias"))


@query("conformal_fold")
def conformal_fold(spark, sf_dir):
    """Adaptive intervals of each zone's day-before forecast; held against a plain walk in the tests."""
    return online.conformal_intervals(zone_pairs(spark, sf_dir), "zone")


@query("fan_calibration")
def fan_calibration(spark, sf_dir):
    """Adaptive intervals at 50 % and 90 %: a walk for each zone and coverage."""
    rows = zone_pairs(spark, sf_dir)
    return online.conformal_intervals(rows, "zone", 0.5).withColumn("coverage", F.lit(0.5)).unionByName(online.conformal_intervals(rows, "zone", 0.9).withColumn("coverage", F.lit(0.9)))


def _curve_pairs(spark, sf_dir):
    """direction, k, ts, actual, pred: 24 levels of both curves of each whole day, with the day before's as forecast."""
    curve = curves.duration_curves(curves.complete_days(days(spark, sf_dir), ["day"]), ["day"], 24)
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("direction"), F.col(c).alias("actual")) for c in ("cheap", "peak")]))
    long = curve.select("k", F.col("day").cast("timestamp").alias("ts"), both.alias("x")).select("x.direction", "k", "ts", "x.actual")
    return align.time_lag(long, ["direction", "k"], "actual", 24, "pred").filter("pred is not null")


@query("curve_bundle")
def curve_bundle(spark, sf_dir):
    """State of 48 interval learners, one for each direction and level of the duration curves."""
    return online.conformal_state(_curve_pairs(spark, sf_dir), ["direction", "k"], window=365, warm=14)


@query("curve_bands")
def curve_bands(spark, sf_dir):
    """Their bands for each day, as arrays over the levels, to four places."""
    bands = online.conformal_intervals(_curve_pairs(spark, sf_dir), ["direction", "k"], window=365, warm=14)
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: F.round(x[c], 4)).alias(c)
    return bands.groupBy("direction", "ts").agg(at("lower"), at("upper"))  # 24 rows a group


@query(
    "static_bands",
    """, e AS (SELECT a.zone, a.ts, a.p AS actual, b.p AS pred FROM zonal a JOIN zonal b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 24 HOUR), q AS (SELECT *, count(*) OVER w AS n, quantile_cont(abs(actual - pred), 0.9) OVER w AS q FROM e WINDOW w AS (PARTITION BY zone ORDER BY ts ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING))
SELECT zone, count(*) AS n, round(avg(CASE WHEN abs(actual - pred) <= q THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(2 * q), 6) AS width FROM q WHERE n >= 14 GROUP BY 1""",
)
def static_bands(spark, sf_dir):
    """Coverage and width of bands from the last 365 errors' 90 % quantile."""
    rows = verify.static_bands(zone_pairs(spark, sf_dir), ["zone"], 0.9, 365, 14)
    return rows.groupBy("zone").agg(F.count("*").alias("n"), r(F.avg(F.col("hit").cast("double"))).alias("coverage"), r(F.avg(F.col("upper") - F.col("lower"))).alias("width"))


_COVERAGE = """, e AS (SELECT a.zone, a.ts, abs(a.p - b.p) <= 30 AS hit FROM zonal a JOIN zonal b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 24 HOUR),
c AS (SELECT zone, ts, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY zone ORDER BY ts ROWS 47 PRECEDING) AS coverage FROM e)
"""


@query(
    "refit_monitor",
    _COVERAGE + """, f AS (SELECT zone, ts, abs(coverage - 0.9) > 0.05 AS off, row_number() OVER (PARTITION BY zone ORDER BY ts) - sum((abs(coverage - 0.9) > 0.05)::INT) OVER (PARTITION BY zone ORDER BY ts) AS run FROM c), g AS (SELECT *, row_number() OVER (PARTITION BY zone, run ORDER BY ts) AS i FROM f WHERE off)
SELECT zone, min(ts) AS start, count(*) AS hours, min(ts) FILTER (i = 12) AS alarm FROM g GROUP BY zone, run HAVING count(*) >= 12""",
)
def refit_monitor(spark, sf_dir):
    """When bands of 30 either side have been off their coverage by five points for twelve rows."""
    last = Window.partitionBy("zone").orderBy("ts").rowsBetween(-47, 0)
    hit = (F.abs(F.col("actual") - F.col("pred")) <= 30).cast("double")
    rows = zone_pairs(spark, sf_dir).withColumn("coverage", F.avg(hit).over(last))
    return online.refit_alarms(rows, ["zone"], "coverage", 0.9, 0.05, 12)


@query(
    "pinball_entropy",
    """, s AS (SELECT event_type AS zone, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS t FROM s), q AS (SELECT quantile_cont(abs(actual - pred), 0.9) AS q FROM pairs)
SELECT round((SELECT -sum(n / t * ln(n / t) / ln(2.0)) FROM s, t), 6) AS bits, round(avg(CASE WHEN abs(actual - pred) >= q THEN 0.1 * (abs(actual - pred) - q) ELSE 0.9 * (q - abs(actual - pred)) END), 6) AS pinball FROM pairs, q""",
)
def pinball_entropy(spark, sf_dir):
    """The pinball loss of the errors' 90 % quantile, and the entropy of the zones' shares of events."""
    from gridloom.session import table

    shares = table(spark, sf_dir, "events").groupBy("event_type").count().agg(F.collect_list("count").alias("c"))  # a number a zone
    bits = shares.select(verify.entropy_bits(F.transform("c", lambda n: n / F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + b))).alias("bits"))
    errors = pairs(spark, sf_dir).select(F.abs(F.col("actual") - F.col("pred")).alias("s"))
    loss = errors.crossJoin(F.broadcast(errors.agg(F.percentile("s", 0.9).alias("q")))).agg(F.avg(verify.pinball(F.col("s"), F.col("q"), 0.1)).alias("l"))
    return bits.crossJoin(F.broadcast(loss)).select(r("bits").alias("bits"), r("l").alias("pinball"))


_LEADS = """, l AS (SELECT unnest([0, 1, 2, 3]) AS lead), d AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS h, ts, p FROM hourly), w AS (SELECT day FROM d GROUP BY 1 HAVING count(*) = 24),
j AS (SELECT lead, d.day, d.p AS realised, f.p AS forecast FROM d JOIN w ON w.day = d.day, l JOIN hourly f ON f.ts = d.ts - to_hours(CAST(24 * (lead + 1) AS BIGINT))),
s AS (SELECT lead, day, sqrt(avg(pow((realised - forecast) / forecast, 2))) AS s FROM j WHERE abs(forecast) > 0.001 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY day) AS n FROM s),
r AS (WITH RECURSIVE r AS (SELECT lead, n, s AS v FROM n WHERE n = 1 UNION ALL SELECT n.lead, n.n, 0.7 * r.v + 0.3 * n.s FROM r JOIN n ON n.lead = r.lead AND n.n = r.n + 1) SELECT * FROM r)
""".replace("FROM d JOIN w ON w.day = d.day, l JOIN hourly f", "FROM d JOIN w ON w.day = d.day CROSS JOIN l JOIN hourly f")


@query(
    "lead_verifier",
    _LEADS + "SELECT CAST(lead AS BIGINT) AS lead, max(n) AS n, round(arg_max(v, n), 6) AS learned, round(max(n) / (max(n) + 10.0) * arg_max(v, n) + (1 - max(n) / (max(n) + 10.0)) * [0.0, 0.0, 0.10, 0.15][lead + 1], 6) AS published FROM r GROUP BY lead",
)
def lead_verifier(spark, sf_dir):
    """Relative error learned for each lead of one to four days, and its blend with the prior."""
    h = hourly(spark, sf_dir)
    realised = curves.complete_days(days(spark, sf_dir), ["day"]).select("day", "ts", F.col("p").alias("realised"))
    made = h.withColumn("lead", F.explode(F.array(*[F.lit(k) for k in range(4)]))).select("lead", F.timestamp_add("HOUR", 24 * (F.col("lead") + 1), F.col("ts")).alias("ts"), F.col("p").alias("forecast"))
    samples = verify.relative_errors(made.join(realised, "ts"), ["lead", "day"], "forecast", "realised")
    learned = verify.learned_errors(samples, "lead", "day")
    return learned.select(F.col("lead").cast("long").alias("lead"), "n", r("learned").alias("learned"), r(verify.published_error(F.col("lead"), F.col("n"), F.col("learned"))).alias("published"))


@query(
    "reconcile_once",
    ", f AS (SELECT zone, ts + INTERVAL 24 HOUR AS ts, p AS forecast FROM zonal), fed AS (SELECT zone, ts FROM zonal WHERE hour(ts) < 6) SELECT f.zone, f.ts, round(a.p, 6) AS actual, round(a.p - forecast, 6) + 0.0 AS error FROM f JOIN zonal a ON a.zone = f.zone AND a.ts = f.ts WHERE NOT EXISTS (SELECT 1 FROM fed WHERE fed.zone = f.zone AND fed.ts = f.ts)",
)
def reconcile_once(spark, sf_dir):
    """Forecasts that an actual has met, other than those fed already (the first six hours)."""
    z = zonal(spark, sf_dir)
    made = z.select("zone", (F.col("ts") + F.expr("interval 24 hours")).alias("ts"), F.col("p").alias("forecast"))
    fed = z.filter(F.hour("ts") < 6).select("zone", "ts")
    met = verify.reconciled(made, z.withColumnRenamed("p", "actual"), fed, ["zone", "ts"])
    return met.select("zone", "ts", r("actual").alias("actual"), r(F.col("actual") - F.col("forecast")).alias("error"))


@query(
    "forecast_ledger",
    "-- ledger\nWITH m AS (SELECT max(ts) AS t FROM events), r AS (SELECT event_type AS zone, date_trunc('hour', ts) AS ts, value, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS n, t FROM events, m) SELECT zone, ts, round(value, 6) AS forecast FROM r WHERE n = 1 AND ts >= t - INTERVAL 14 DAY",
)
def forecast_ledger(spark, sf_dir):
    """The last value told for each zone's hour, none older than 14 days."""
    from gridloom.session import table

    told = table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.col("ts").cast("timestamp").alias("told"), "event_id", F.col("value").alias("forecast"))
    return verify.ledger(told, ["zone", "ts"], ["told", "event_id"], 14).select("zone", "ts", r("forecast").alias("forecast"))
