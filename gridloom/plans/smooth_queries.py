"""Queries on lags, smoothing, resampling and seasonal parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import align, scores, smooth
from gridloom.plans.base import hourly, pairs, query, r, zonal
from gridloom.session import table

_W = "PARTITION BY zone ORDER BY ts"


@query(
    "lagged_rolling_mean",
    f"SELECT zone, ts, CASE WHEN count(p) OVER (x) >= 24 THEN round(avg(p) OVER (x) + 1e-9, 6) END AS week_before, round(lag(p, 3) OVER ({_W}), 6) AS back, round(lead(p, 3) OVER ({_W}), 6) AS ahead FROM zonal".replace(
        "(x)", f"({_W} ROWS BETWEEN 335 PRECEDING AND 168 PRECEDING)"
    ),
)
def lagged_rolling_mean(spark, sf_dir):
    """The mean of the 168 rows that end 168 rows before (24 at least), and values three rows back and ahead."""
    order = Window.partitionBy("zone").orderBy("ts")
    return zonal(spark, sf_dir).select("zone", "ts", r(smooth.lagged_mean(["zone"], "p", 168, 168, 24) + 1e-9).alias("week_before"), r(F.lag("p", 3).over(order)).alias("back"), r(F.lead("p", 3).over(order)).alias("ahead"))


@query("rolling_quarter_median", "SELECT zone, ts, CASE WHEN count(p) OVER w >= 24 THEN round(median(p) OVER w, 6) END AS middle FROM zonal WINDOW w AS (PARTITION BY zone ORDER BY ts RANGE BETWEEN INTERVAL 7775999 SECOND PRECEDING AND CURRENT ROW)")
def rolling_quarter_median(spark, sf_dir):
    """The median of the last 90 days, of 24 rows at least."""
    from gridloom.operators import sliding

    return sliding.by_hours(zonal(spark, sf_dir), ["zone"], "p", 90 * 24, {"middle": 0.5}, 24, 240).select("zone", "ts", r("middle").alias("middle"))


@query(
    "filled_centred_mean",
    f""", c AS (SELECT zone, ts, CASE WHEN count(p) OVER w = 4 THEN avg(p) OVER w END AS m FROM zonal WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))
SELECT zone, ts, round(coalesce(last_value(m IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), first_value(m IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS mean FROM c""",
)
def filled_centred_mean(spark, sf_dir):
    """Centred means of four rows, the ends filled from the nearest."""
    means = zonal(spark, sf_dir).select("zone", "ts", smooth.centred_mean(["zone"], "p", 4).alias("m"))
    return means.select("zone", "ts", r(smooth.filled(["zone"], "m")).alias("mean"))


@query(
    "ewm_mean",
    f""", n AS (SELECT zone, ts, p, row_number() OVER ({_W}) AS n FROM zonal)
SELECT a.zone, a.ts, round(sum(b.p * pow(47.0 / 49, a.n - b.n)) / sum(pow(47.0 / 49, a.n - b.n)), 6) AS ewm FROM n a JOIN n b ON a.zone = b.zone AND b.n BETWEEN a.n - 719 AND a.n GROUP BY 1, 2""",
)
def ewm_mean(spark, sf_dir):
    """Exponentially weighted means with a span of 48."""
    return zonal(spark, sf_dir).select("zone", "ts", r(smooth.ewm(["zone"], "p", 48)).alias("ewm"))


_KERNEL = smooth.trapezoid(9)


@query(
    "trapezoid_smooth",
    "SELECT zone, ts, round("
    + " + ".join(f"{w!r} * coalesce({'lag' if k > 0 else 'lead'}(p, {abs(k)}) OVER ({_W}), 0)" for k, w in zip(range(-4, 5), _KERNEL))
    + f", 6) + 0.0 AS smooth FROM zonal",
)
def trapezoid_smooth(spark, sf_dir):
    """Prices under a trapezoid of nine rows, with zeros beyond the ends."""
    return zonal(spark, sf_dir).select("zone", "ts", r(smooth.convolved(["zone"], "p", _KERNEL)).alias("smooth"))


@query(
    "bounded_interpolation",
    """, b AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM zonal GROUP BY 1), g AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b),
v AS (SELECT g.zone, g.ts, CASE WHEN hour(g.ts) % 12 >= 8 THEN NULL ELSE z.p END AS p FROM g LEFT JOIN zonal z ON g.zone = z.zone AND g.ts = z.ts),
k AS (SELECT zone, ts, p FROM v WHERE p IS NOT NULL), l AS (SELECT v.zone, v.ts, v.p, k.ts AS t0, k.p AS p0 FROM v ASOF LEFT JOIN k ON v.zone = k.zone AND v.ts >= k.ts), h AS (SELECT l.*, k.ts AS t1, k.p AS p1 FROM l ASOF LEFT JOIN k ON l.zone = k.zone AND l.ts <= k.ts)
SELECT zone, ts, round(CASE WHEN p IS NOT NULL THEN p WHEN date_diff('hour', t0, ts) <= 6 THEN p0 + (p1 - p0) * date_diff('hour', t0, ts) / date_diff('hour', t0, t1) END, 6) AS p FROM h""",
)
def bounded_interpolation(spark, sf_dir):
    """Hours of which four in twelve are taken out, filled along lines of up to six hours."""
    z = zonal(spark, sf_dir)
    grid = align.hour_grid(z, ["zone"]).join(z, ["zone", "ts"], "left").withColumn("p", F.when(F.hour("ts") % 12 < 8, F.col("p")))
    return smooth.interpolated(grid, ["zone"], "p", 6).select("zone", "ts", r("p").alias("p"))


@query(
    "cross_correlation",
    ", n AS (SELECT zone, z.ts, z.p AS a, h.p AS b FROM zonal z JOIN hourly h ON z.ts = h.ts), x AS ("
    + " UNION ALL ".join(f"SELECT zone, CAST({k} AS BIGINT) AS lag, a, {'lag' if k >= 0 else 'lead'}(b, {abs(k)}) OVER ({_W}) AS b FROM n" for k in (-3, 0, 1, 24))
    + ") SELECT zone, lag, round(corr(a, b), 6) AS corr FROM x WHERE b IS NOT NULL GROUP BY 1, 2",
)
def cross_correlation(spark, sf_dir):
    """Each zone's correlation with the mean price at four lags."""
    rows = zonal(spark, sf_dir).withColumnRenamed("p", "a").join(hourly(spark, sf_dir).withColumnRenamed("p", "b"), "ts")
    return smooth.cross_correlation(rows, ["zone"], "a", "b", [-3, 0, 1, 24]).select("zone", F.col("lag").cast("long").alias("lag"), r("corr").alias("corr"))


@query(
    "ljung_box",
    f""", c AS (SELECT zone, ts, p - avg(p) OVER (PARTITION BY zone) AS c FROM zonal), n AS (SELECT zone, c, row_number() OVER ({_W}) AS i FROM c), s AS (SELECT zone, count(*) AS n, avg(c * c) AS v FROM n GROUP BY 1),
k AS (SELECT a.zone, a.i - b.i AS k, sum(a.c * b.c) AS s FROM n a JOIN n b ON a.zone = b.zone AND a.i - b.i BETWEEN 1 AND 24 GROUP BY 1, 2)
SELECT k.zone, min(n) AS n, round(min(n) * (min(n) + 2) * sum(pow(k.s / ((n - k) * v), 2) / (n - k)), 5) AS q FROM k JOIN s ON s.zone = k.zone GROUP BY 1""",
)
def ljung_box(spark, sf_dir):
    """Whether a zone's prices go on from hour to hour, by 24 lags."""
    return smooth.ljung_box(zonal(spark, sf_dir), ["zone"], "p").select("zone", "n", r("q", 5).alias("q"))


@query("block_starts", f"SELECT zone, ts FROM (SELECT zone, ts, lead(ts, 23) OVER ({_W}) AS l FROM zonal) WHERE date_diff('hour', ts, l) = 23")
def block_starts(spark, sf_dir):
    """Hours that start a run of 24 without a gap."""
    return smooth.block_starts(zonal(spark, sf_dir), ["zone"])


@query(
    "resample_levels",
    "SELECT level, ts, round(avg(p), 6) AS mean, round(max(p), 6) AS high, count(*) AS hours FROM (SELECT unnest(['day', 'month', 'year']) AS level, unnest([date_trunc('day', ts), date_trunc('month', ts), date_trunc('year', ts)])::TIMESTAMP AS ts, p FROM hourly) GROUP BY 1, 2",
)
def resample_levels(spark, sf_dir):
    """Means and maxima by day, month and year in one pass."""
    levels = F.array(*[F.struct(F.lit(x).alias("level"), F.date_trunc(x, "ts").alias("ts")) for x in ("day", "month", "year")])
    rows = hourly(spark, sf_dir).select(F.explode(levels).alias("x"), "p").select("x.*", "p")
    return rows.groupBy("level", "ts").agg(r(F.avg("p")).alias("mean"), r(F.max("p")).alias("high"), F.count("*").alias("hours"))


@query("rolling_daily_mae", ", d AS (SELECT CAST(ts AS DATE) AS day, avg(abs(actual - pred)) AS m FROM pairs GROUP BY 1) SELECT day, round(m, 6) AS daily, round(avg(m) OVER (ORDER BY day ROWS 13 PRECEDING), 6) AS rolling FROM d")
def rolling_daily_mae(spark, sf_dir):
    """Each day's mean error and that of the 14 days up to it."""
    daily = pairs(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("m"))
    last = Window.partitionBy().orderBy("day").rowsBetween(-13, 0)  # a row a day
    return daily.select("day", r("m").alias("daily"), r(F.avg("m").over(last)).alias("rolling"))


@query(
    "lead_buckets",
    ", o AS (SELECT ts AS origin FROM hourly WHERE hour(ts) = 6), x AS (SELECT o.origin, h.ts, CAST(ceil(epoch(h.ts - o.origin) / 86400.0) AS BIGINT) AS lead_day, abs(h.p - b.p) AS e FROM o JOIN hourly b ON b.ts = o.origin JOIN hourly h ON h.ts > o.origin AND h.ts <= o.origin + INTERVAL 170 HOUR) SELECT lead_day, count(*) AS n, round(avg(e), 6) AS mae FROM x GROUP BY 1",
)
def lead_buckets(spark, sf_dir):
    """Errors of each 6 o'clock price held for 170 hours, by day of lead: origins are dealt to their hours, then joined by hour."""
    h = hourly(spark, sf_dir)
    origins = h.filter(F.hour("ts") == 6).select(F.col("ts").alias("origin"), F.col("p").alias("held"), F.explode(F.sequence(F.lit(1), F.lit(170))).alias("step"))
    ahead = origins.select("origin", "held", F.timestamp_add("HOUR", F.col("step"), F.col("origin")).alias("ts")).join(h, "ts")
    bucket = smooth.lead_day(F.col("ts"), F.col("origin")).cast("long").alias("lead_day")
    return ahead.groupBy(bucket).agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("p") - F.col("held")))).alias("mae"))


_BINS = {"hour": (F.hour, 24), "day": (F.weekday, 7), "week": (lambda c: F.weekofyear(c) - 1, 53)}
_PARTS = """, a AS (SELECT zone, ts, p, p - avg(p) OVER (PARTITION BY zone, hour(ts)) AS r1 FROM zonal), b AS (SELECT *, r1 - avg(r1) OVER (PARTITION BY zone, isodow(ts)) AS r2 FROM a),
m AS (SELECT zone, 'hour' AS part, hour(ts) AS bin, avg(p) AS mean FROM a GROUP BY 1, 3 UNION ALL SELECT zone, 'day', isodow(ts) - 1, avg(r1) FROM b GROUP BY 1, 3 UNION ALL SELECT zone, 'week', weekofyear(ts) - 1, avg(r2) FROM b GROUP BY 1, 3)
"""


def _parts(spark, sf_dir):
    return smooth.profile(zonal(spark, sf_dir), ["zone"], "p", {k: (f("ts"), n) for k, (f, n) in _BINS.items()})


@query("seasonal_artifact", _PARTS + "SELECT zone, part, CAST(bin AS BIGINT) AS bin, round(mean, 6) + 0.0 AS mean FROM m")
def seasonal_artifact(spark, sf_dir):
    """The seasonal parts as a table of bins."""
    return _parts(spark, sf_dir).select("zone", "part", F.col("bin").cast("long").alias("bin"), r("mean").alias("mean"))


@query(
    "seasonal_reconstruct",
    _PARTS + "SELECT z.zone, z.ts + INTERVAL 400 DAY AS ts, round(coalesce(h.mean, 0) + coalesce(d.mean, 0) + coalesce(w.mean, 0), 6) + 0.0 AS seasonal FROM zonal z LEFT JOIN m h ON h.zone = z.zone AND h.part = 'hour' AND h.bin = hour(z.ts + INTERVAL 400 DAY) LEFT JOIN m d ON d.zone = z.zone AND d.part = 'day' AND d.bin = isodow(z.ts + INTERVAL 400 DAY) - 1 LEFT JOIN m w ON w.zone = z.zone AND w.part = 'week' AND w.bin = weekofyear(z.ts + INTERVAL 400 DAY) - 1",
)
def seasonal_reconstruct(spark, sf_dir):
    """What the parts say of times 400 days later; bins not seen count as 0."""
    later = zonal(spark, sf_dir).select("zone", (F.col("ts") + F.expr("interval 400 days")).alias("ts"))
    return smooth.seasonal_part(later, ["zone"], _parts(spark, sf_dir), {k: f("ts") for k, (f, _) in _BINS.items()}).select("zone", "ts", r("seasonal").alias("seasonal"))


@query(
    "weeks_nearest_filled",
    """, m AS (SELECT zone, weekofyear(ts) - 1 AS bin, avg(p) AS mean FROM zonal GROUP BY 1, 2), e AS (SELECT z.zone, i AS bin FROM (SELECT DISTINCT zone FROM m) z, range(53) t(i))
SELECT e.zone, CAST(e.bin AS BIGINT) AS week, round(arg_min(m.mean, abs(m.bin - e.bin) * 100 + m.bin), 6) AS mean FROM e JOIN m ON m.zone = e.zone GROUP BY 1, 2""",
)
def weeks_nearest_filled(spark, sf_dir):
    """Weekly means for all 53 weeks; weeks not seen take the nearest."""
    means = zonal(spark, sf_dir).groupBy("zone", (F.weekofyear("ts") - 1).alias("bin")).agg(F.avg("p").alias("mean"))
    return smooth.nearest_filled(means, ["zone"], 53).select("zone", F.col("bin").cast("long").alias("week"), r("mean").alias("mean"))


@query(
    "rolling_spearman",
    """, d AS (SELECT CAST(ts AS DATE) AS day, avg(actual) AS a, avg(pred) AS b FROM pairs GROUP BY 1), j AS (SELECT o.day, d.a, d.b FROM d o JOIN d ON d.day BETWEEN o.day - 89 AND o.day),
k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY a) AS a, rank() OVER (PARTITION BY day ORDER BY b) AS b, count(*) OVER (PARTITION BY day) AS n FROM j) SELECT day, round(corr(a, b), 6) AS rho FROM k WHERE n >= 5 GROUP BY 1""",
)
def rolling_spearman(spark, sf_dir):
    """Rank correlation of daily means over the 90 days up to each (five at least): each day is dealt to the days that look back on it."""
    daily = pairs(spark, sf_dir).groupBy(F.to_date("ts").alias("of")).agg(F.avg("actual").alias("a"), F.avg("pred").alias("b"))
    days = daily.select(F.col("of").alias("day"))
    dealt = daily.select(F.explode(F.sequence("of", F.date_add("of", 89))).alias("day"), "a", "b").join(days, "day", "left_semi")
    enough = dealt.withColumn("n", F.count("*").over(Window.partitionBy("day"))).filter("n >= 5")
    return scores.spearman(enough, ["day"], "a", "b").select("day", r("rho").alias("rho"))


@query("keep_first_dedup", "-- first\nSELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def keep_first_dedup(spark, sf_dir):
    """The first event of each user and type."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return align.earliest(rows, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_id", r("value").alias("value"))
