"""Queries on joined frames, grouped models, rolling tails, and scenarios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.operators import absolute, align, curves, fits, models, panels, scores, searches, series, smooth, statespace, subsets, tails
from gridloom.plans.base import HOLIDAY_STEPS, LOCAL, days, hourly, pairs, query, r, zonal
from gridloom.plans.fit_queries import _ROWS, _SCALED, _SUMS, _rows
from gridloom.plans.panel_queries import _DRAW
from gridloom.session import table
from gridloom.streaming import online

_WIDE = ", z AS (SELECT event_type AS zone, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), wd AS (SELECT ts, max(p) FILTER (i = 1) AS a, max(p) FILTER (i = 2) AS b, max(p) FILTER (i = 3) AS c FROM zonal JOIN z USING (zone) GROUP BY 1)\n"


def wide(spark, sf_dir, zones: list[str] | None = None):
    """ts, a, b, c: three zones side by side, for models of a region and two neighbours. zones: their names; by default the first three in
    the order of names. Other zones take no part in such a model."""
    z = zonal(spark, sf_dir)
    names = zones or [x["zone"] for x in z.select("zone").distinct().orderBy("zone").limit(3).collect()]
    return z.groupBy("ts").pivot("zone", names).agg(F.max("p")).toDF("ts", "a", "b", "c")


@query(
    "household_frame",
    _WIDE + "SELECT h.ts, round(h.p, 6) AS price, round(wd.a / 100 + CASE WHEN h.ts >= TIMESTAMP '2024-01-10' THEN greatest(coalesce(wd.c, 0) / 100 - coalesce(wd.b, 0) / 100, 0) ELSE 0 END, 6) AS demand, wd.b IS NULL AS no_export FROM wd JOIN hourly h ON h.ts = wd.ts WHERE wd.a IS NOT NULL",
)
def household_frame(spark, sf_dir):
    """Import with price, export (0 where missing) and own yield: demand is import, and from a date on what panels gave beyond the export."""
    w = wide(spark, sf_dir).filter("a is not null").join(hourly(spark, sf_dir), "ts")
    own = F.greatest(F.coalesce("c", F.lit(0.0)) / 100 - F.coalesce("b", F.lit(0.0)) / 100, F.lit(0.0))
    demand = F.col("a") / 100 + F.when(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"), own).otherwise(0.0)
    return w.select("ts", r("p").alias("price"), r(demand).alias("demand"), F.col("b").isNull().alias("no_export"))


@query(
    "model_frame",
    _WIDE + "SELECT wd.ts, round(h.p, 6) AS price, round(wd.a - wd.b, 6) + 0.0 AS spread, round(l.p, 6) AS week_before, round(h.p - avg(h.p) OVER (PARTITION BY CAST(h.ts AS DATE)), 6) + 0.0 AS about_day FROM wd JOIN hourly h ON h.ts = wd.ts JOIN hourly l ON l.ts = wd.ts - INTERVAL 168 HOUR WHERE wd.a IS NOT NULL AND wd.b IS NOT NULL",
)
def model_frame(spark, sf_dir):
    """Hours that all series have: price, spread of two zones, the week before, and the price about its day's mean."""
    from gridloom.operators.align import time_lag

    rows = time_lag(hourly(spark, sf_dir), [], "p", 168, "past").filter("past is not null").join(wide(spark, sf_dir).select("ts", "a", "b").na.drop(), "ts")
    about = F.col("p") - F.avg("p").over(Window.partitionBy(F.to_date("ts")))
    return rows.select("ts", r("p").alias("price"), r(F.col("a") - F.col("b")).alias("spread"), r("past").alias("week_before"), r(about).alias("about_day"))


@query(
    "forecast_clock",
    ", n AS (SELECT max(ts) - INTERVAL 48 HOUR AS now FROM hourly), f AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS step FROM hourly, n WHERE ts >= now), z AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS p FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1) SELECT f.ts, step, round(z.p, 6) AS neighbour FROM f LEFT JOIN z ON z.ts = f.ts",
)
def forecast_clock(spark, sf_dir):
    """The last 48 hours as a forecast's clock, numbered, with a zone's hourly means where there are any."""
    h = hourly(spark, sf_dir)
    ahead = h.crossJoin(F.broadcast(h.agg((F.max("ts") - F.expr("interval 48 hours")).alias("now")))).filter("ts >= now")
    first = table(spark, sf_dir, "events").agg(F.min("event_type").alias("zone"))
    z = zonal(spark, sf_dir).join(F.broadcast(first), "zone").select("ts", F.col("p").alias("neighbour"))
    # 49 rows
    return ahead.select("ts", (F.row_number().over(Window.partitionBy().orderBy("ts")) - 1).cast("long").alias("step")).join(z, "ts", "left").select("ts", "step", r("neighbour").alias("neighbour"))


@query(
    "week_offsets",
    "-- weeks\nWITH w AS (SELECT isoyear(o_orderdate) AS y, weekofyear(o_orderdate) AS w, avg(o_totalprice) AS t FROM orders GROUP BY 1, 2), o AS (SELECT y, w, t - avg(t) OVER (PARTITION BY w) AS off FROM w) SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, round(avg(coalesce(off, 0)), 4) + 0.0 AS off FROM orders LEFT JOIN o ON y = isoyear(o_orderdate) AND w = weekofyear(o_orderdate) AND w % 2 = 0 GROUP BY 1",
)
def week_offsets(spark, sf_dir):
    """Each day's orders with their week's offset from that week over the years; 0 for weeks without one (the odd ones)."""
    from gridloom.sources.readers import week_offsets as offsets

    year = F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("int")
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), year.alias("year"), F.weekofyear("o_orderdate").alias("week"), "o_totalprice")
    known = offsets(orders.groupBy("year", "week").agg(F.avg("o_totalprice").alias("total"))).filter("week % 2 = 0").select("year", "week", "offset")
    return orders.join(known, ["year", "week"], "left").groupBy("day").agg(F.count("*").alias("n"), r(F.avg(F.coalesce("offset", F.lit(0.0))), 4).alias("off"))


@query(
    "local_load_profile",
    f", l AS (SELECT isodow({LOCAL}) - 1 AS wd, hour({LOCAL}) AS h, p FROM hourly) SELECT CAST(wd AS BIGINT) AS weekday, CAST(h AS BIGINT) AS hour, count(*) AS n, round(avg(p), 6) AS mean, round(avg(p) / (SELECT avg(p) FROM l), 6) AS share, round(stddev_samp(p), 6) AS sd, round(quantile_cont(p, 0.1), 6) AS base FROM l GROUP BY 1, 2",
)
def local_load_profile(spark, sf_dir):
    """Mean, share of the mean, spread and 10 % envelope by local weekday and hour."""
    at = calendar.local(F.col("ts"))
    rows = hourly(spark, sf_dir).select(F.weekday(at).cast("long").alias("weekday"), F.hour(at).cast("long").alias("hour"), "p")
    return rows.crossJoin(F.broadcast(rows.agg(F.avg("p").alias("all")))).groupBy("weekday", "hour").agg(F.count("*").alias("n"), r(F.avg("p")).alias("mean"), r(F.avg("p") / F.first("all")).alias("share"), r(F.stddev_samp("p")).alias("sd"), r(F.percentile("p", 0.1)).alias("base"))


@query(
    "profile_record",
    f", l AS (SELECT isodow({LOCAL}) - 1 AS wd, hour({LOCAL}) AS h, p FROM hourly), c AS (SELECT wd, h, round(avg(p) / (SELECT avg(p) FROM l), 4) AS s FROM l GROUP BY 1, 2) SELECT CAST(wd AS BIGINT) AS weekday, list(s ORDER BY h) AS shape FROM c GROUP BY wd",
)
def profile_record(spark, sf_dir):
    """The profile as a record: an array of 24 shares for each weekday."""
    at = calendar.local(F.col("ts"))
    rows = hourly(spark, sf_dir).select(F.weekday(at).cast("long").alias("weekday"), F.hour(at).alias("hour"), "p")
    share = rows.crossJoin(F.broadcast(rows.agg(F.avg("p").alias("all")))).groupBy("weekday", "hour").agg(r(F.avg("p") / F.first("all"), 4).alias("s"))
    return share.groupBy("weekday").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "s"))), lambda x: x["s"]).alias("shape"))


@query(
    "announcement_lead",
    "-- lead\nSELECT o_orderpriority AS kind, count(*) AS n, round(median(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 6) AS lead, round(avg(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 60 THEN 1e0 ELSE 0e0 END), 6) AS early FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def announcement_lead(spark, sf_dir):
    """Median days from order to shipping by priority, and the share above 60."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("told"), F.col("o_orderpriority").alias("kind"))
    lead = F.date_diff(F.to_date("l_shipdate"), "told")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_shipdate").join(o, "key").select("kind", lead.alias("lead"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), r(F.percentile("lead", 0.5)).alias("lead"), r(F.avg((F.col("lead") > 60).cast("double"))).alias("early"))


_CAP = ", c AS (SELECT zone, ts, p, max(p) OVER (PARTITION BY zone ORDER BY ts ROWS 1439 PRECEDING) AS cap FROM zonal)"


@query(
    "capacity_profile",
    _CAP + ", f AS (SELECT *, p < 0.8 * cap AS low, row_number() OVER (PARTITION BY zone ORDER BY ts) - sum((p < 0.8 * cap)::INT) OVER (PARTITION BY zone ORDER BY ts) AS run FROM c), e AS (SELECT zone, count(*) AS h FROM f WHERE low GROUP BY zone, run HAVING count(*) >= 6) SELECT c.zone, CAST(year(ts) AS BIGINT) AS year, round(max(p), 6) AS most, round(avg(cap - p), 6) AS deficit, (SELECT count(*) FROM e WHERE e.zone = c.zone) AS episodes FROM c GROUP BY 1, 2",
)
def capacity_profile(spark, sf_dir):
    """Each zone's highest value and mean lack of its last 60 days' highest, by year, and runs of six hours below 80 % of it."""
    last = Window.partitionBy("zone").orderBy("ts").rowsBetween(-1439, 0)
    rows = zonal(spark, sf_dir).withColumn("cap", F.max("p").over(last))
    runs = series.episodes(rows, ["zone"], F.col("p") < 0.8 * F.col("cap"), 6).groupBy("zone").agg(F.count("*").alias("episodes"))
    by_year = rows.groupBy("zone", F.year("ts").cast("long").alias("year")).agg(r(F.max("p")).alias("most"), r(F.avg(F.col("cap") - F.col("p"))).alias("deficit"))
    return by_year.join(runs, "zone", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))


@query("weighted_moments", _ROWS + "SELECT round(sum(w * a) / sum(w), 6) + 0.0 AS a_mean, round(sqrt(greatest(sum(w * a * a) / sum(w) - pow(sum(w * a) / sum(w), 2), 0)), 6) AS a_sd, round(sum(w * b) / sum(w), 6) AS b_mean, round(sqrt(greatest(sum(w * b * b) / sum(w) - pow(sum(w * b) / sum(w), 2), 0)), 6) AS b_sd FROM w")
def weighted_moments(spark, sf_dir):
    """Weighted means and spreads from one aggregate."""
    return _rows(spark, sf_dir).agg(*[x for c in ("a", "b") for x in (r(scores.weighted_mean(c, "weight")).alias(f"{c}_mean"), r(scores.weighted_sd(c, "weight")).alias(f"{c}_sd"))])


@query(
    "low_resolution_fit",
    ", s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS t, avg(actual) AS y, avg(pred) AS x FROM pairs GROUP BY 1), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s), c AS (SELECT ts, avg(pred) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m, count(*) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS n FROM pairs) SELECT ts, round(a + b * m, 6) AS fitted FROM c, f WHERE n = 6",
)
def low_resolution_fit(spark, sf_dir):
    """A line fitted on six-hour means, read at each hour from the mean around it."""
    rows = pairs(spark, sf_dir)
    low = rows.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.avg("actual").alias("y"), F.avg("pred").alias("x"))
    line = low.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    around = rows.select("ts", smooth.centred_mean([], "pred", 6).alias("m")).filter("m is not null")
    return around.crossJoin(F.broadcast(line)).select("ts", r(F.col("a") + F.col("b") * F.col("m")).alias("fitted"))


@query("feature_importance", _ROWS + _SUMS + _SCALED + ", i AS (SELECT 'a' AS feature, abs(ca) * (SELECT stddev_pop(a) FROM w) AS s FROM f UNION ALL SELECT 'b', abs(cb) * (SELECT stddev_pop(b) FROM w) FROM f) SELECT feature, round(s, 6) AS importance, rank() OVER (ORDER BY s DESC) AS place FROM i")
def feature_importance(spark, sf_dir):
    """Features by the size of their coefficient times their spread."""
    rows = _rows(spark, sf_dir)
    c = fits.ridge(rows, "y", ["a", "b"], 1.0, "weight", True)
    spreads = rows.agg(F.array(*[F.struct(F.lit(f).alias("feature"), (abs(c[f]) * F.stddev_pop(f)).alias("s")) for f in ("a", "b")]).alias("x"))
    each = spreads.select(F.explode("x").alias("x")).select("x.feature", "x.s")
    return each.select("feature", r("s").alias("importance"), F.rank().over(Window.partitionBy().orderBy(F.desc("s"))).cast("long").alias("place")).filter("place <= 20")


@query(
    "best_variant",
    _WIDE + ", j AS (SELECT wd.ts, h.p AS y, wd.a, wd.b, wd.c, day(wd.ts) <= 15 AS train FROM wd JOIN hourly h ON h.ts = wd.ts WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), l AS (SELECT 'a' AS feature, ts, y, a AS x, train FROM j UNION ALL SELECT 'b', ts, y, b, train FROM j UNION ALL SELECT 'c', ts, y, c, train FROM j), f AS (SELECT feature, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM l WHERE train GROUP BY 1), e AS (SELECT l.feature, avg(abs(y - i - s * x)) AS mae FROM l JOIN f ON l.feature = f.feature WHERE NOT train GROUP BY 1) SELECT feature, round(mae, 6) AS mae, mae = (SELECT min(mae) FROM e) AS best FROM e",
)
def best_variant(spark, sf_dir):
    """Three single-feature models from one matrix, scored on what they weren't fitted on."""
    rows = wide(spark, sf_dir).join(hourly(spark, sf_dir), "ts")
    return models.best_single(rows, "p", ["a", "b", "c"], F.dayofmonth("ts") <= 15).select("feature", r("mae").alias("mae"), "best")


@query(
    "duration_train",
    ", sg AS (SELECT day, hour // 6 AS seg, hour, p FROM whole), k AS (SELECT day, seg, row_number() OVER (PARTITION BY day, seg ORDER BY p, hour) AS k, avg(p) OVER (PARTITION BY day, seg ORDER BY p, hour ROWS UNBOUNDED PRECEDING) AS cheap FROM sg), m AS (SELECT day, avg(p) AS mean FROM whole GROUP BY 1), x AS (SELECT k.seg, k.k, ln(greatest(cheap + 55, 1)) AS y, b.mean AS x FROM k JOIN m b ON b.day = k.day - 1) SELECT CAST(seg AS BIGINT) AS segment, k, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) AS intercept FROM x GROUP BY 1, 2",
)
def duration_train(spark, sf_dir):
    """A log-linear model for each segment and level of the cheap curves on the day before's mean price, 24 fits from one aggregate."""
    whole = curves.complete_days(days(spark, sf_dir), ["day"])
    curve = curves.duration_curves(whole.withColumn("segment", (F.col("hour") / 6).cast("int")), ["day", "segment"], 6)
    before = whole.groupBy(F.date_add("day", 1).alias("day")).agg(F.avg("p").alias("x"))
    rows = curve.join(before, "day").select("segment", "k", F.ln(F.greatest(F.col("cheap") + 55, F.lit(1.0))).alias("y"), "x")
    fit = models.grouped_ridge(rows, ["segment", "k"], "y", ["x"])
    return fit.groupBy(F.col("segment").cast("long").alias("segment"), F.col("k").cast("long").alias("k")).agg(r(F.max(F.when(F.col("feature") == "x", F.col("coef")))).alias("slope"), r(F.max(F.when(F.col("feature") == "intercept", F.col("coef")))).alias("intercept"))


@query(
    "histogram_models",
    ", b AS (SELECT day, least(greatest(floor(p / 25), 0), 3) AS bin FROM whole), s AS (SELECT d.day, k.bin, avg(CASE WHEN b.bin = k.bin THEN 1e0 ELSE 0e0 END) AS share FROM (SELECT DISTINCT day FROM b) d, (SELECT unnest([0, 1, 2, 3]) AS bin) k, b WHERE b.day = d.day GROUP BY 1, 2), m AS (SELECT day + 1 AS day, avg(p) AS x FROM whole GROUP BY 1), j AS (SELECT s.day, bin, share, x FROM s JOIN m ON m.day = s.day), f AS (SELECT bin, regr_slope(share, x) AS b, regr_intercept(share, x) AS a FROM j GROUP BY 1), p AS (SELECT j.day, j.bin, greatest(a + b * x, 0) AS v FROM j JOIN f ON f.bin = j.bin) SELECT day, CAST(bin AS BIGINT) AS bin, round(v / sum(v) OVER (PARTITION BY day), 6) AS share FROM p",
)
def histogram_models(spark, sf_dir):
    """A line for each of four bins' shares on the day before's mean price; negative ones count as 0, and a day's add up to 1."""
    whole = curves.complete_days(days(spark, sf_dir), ["day"])
    place = F.least(F.greatest(F.floor(F.col("p") / 25), F.lit(0)), F.lit(3))
    shares = whole.withColumn("bin", place).groupBy("day").agg(*[F.avg((F.col("bin") == k).cast("double")).alias(f"s{k}") for k in range(4)])
    before = whole.groupBy(F.date_add("day", 1).alias("day")).agg(F.avg("p").alias("x"))
    rows = shares.join(before, "day").select("day", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("bin"), F.col(f"s{k}").alias("share")) for k in range(4)])).alias("e")).select("day", "x", "e.*")
    fit = models.grouped_ridge(rows, ["bin"], "share", ["x"]).groupBy("bin").pivot("feature", ["intercept", "x"]).agg(F.first("coef")).toDF("bin", "a", "b")
    told = rows.join(F.broadcast(fit), "bin").withColumn("v", F.greatest(F.col("a") + F.col("b") * F.col("x"), F.lit(0.0)))
    return told.select("day", F.col("bin").cast("long").alias("bin"), r(F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("day")))).alias("share"))


@query(
    "rolling_tails",
    """, d AS (SELECT zone, ts, p - avg(p) OVER (PARTITION BY zone) AS x FROM zonal), o AS (SELECT DISTINCT zone, CAST(ts AS DATE) AS origin FROM d WHERE day(ts) % 7 = 0), w AS (SELECT o.zone, o.origin, x FROM o JOIN d ON d.zone = o.zone AND CAST(d.ts AS DATE) < o.origin AND CAST(d.ts AS DATE) >= o.origin - 14),
q AS (SELECT zone, origin, quantile_cont(abs(x), 0.85) AS u, count(*) AS n FROM w GROUP BY 1, 2), y AS (SELECT w.zone, w.origin, CAST(sign(x) AS INTEGER) AS side, u, n, abs(x) - u AS y FROM w JOIN q ON q.zone = w.zone AND q.origin = w.origin WHERE abs(x) > u), i AS (SELECT *, row_number() OVER (PARTITION BY zone, origin, side ORDER BY y) AS i, count(*) OVER (PARTITION BY zone, origin, side) AS m FROM y),
f AS (SELECT zone, origin, side, min(u) AS u, min(n) AS n, count(*) AS n_over, avg(y) AS a0, avg(y * (m - i) / (m - 1)) AS a1 FROM i WHERE m >= 10 GROUP BY 1, 2, 3), g AS (SELECT *, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS scale FROM f WHERE a0 > 2 * a1), v AS (SELECT *, u + scale * CASE WHEN abs(xi) < 1e-9 THEN ln(n_over / n / 0.01) ELSE (pow(n_over / n / 0.01, xi) - 1) / xi END AS var FROM g)
SELECT zone, origin, side, n, round(xi, 5) + 0.0 AS xi, CASE WHEN 0.01 < n_over / n THEN CASE WHEN xi < 1 THEN round((var + scale - xi * u) / (1 - xi), 4) ELSE 'inf'::DOUBLE END END AS cvar FROM v""",
)
def rolling_tails(spark, sf_dir):
    """Tails refitted each week on the 14 days before, and their 1 % mean: each hour is dealt to the origins that look back on it."""
    z = zonal(spark, sf_dir)
    rows = z.withColumn("x", F.col("p") - F.avg("p").over(Window.partitionBy("zone"))).withColumn("day", F.to_date("ts"))
    origins = rows.select("zone", F.col("day").alias("origin")).filter(F.dayofmonth("origin") % 7 == 0).distinct()
    dealt = rows.select("zone", "x", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 14))).alias("origin")).join(origins, ["zone", "origin"], "left_semi")
    fit = tails.gpd_fit(tails.exceedances(dealt, ["zone", "origin"], "x", 0.85), ["zone", "origin"], 10)
    return fit.select("zone", "origin", "side", "n", r("xi", 5).alias("xi"), r(tails.gpd_cvar(0.01), 4).alias("cvar"))


@query(
    "tail_mixture",
    """, x AS (SELECT zone, -(p - avg(p) OVER (PARTITION BY zone)) AS x FROM zonal), q AS (SELECT zone, quantile_cont(abs(x), 0.9) AS u, count(*) AS n FROM x GROUP BY 1), a AS (SELECT unnest([0.02, 0.25]::DOUBLE[]) AS alpha),
y AS (SELECT x.zone, u, n, x - u AS y FROM x JOIN q ON q.zone = x.zone WHERE x > u), i AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY y) AS i, count(*) OVER (PARTITION BY zone) AS m FROM y),
f AS (SELECT zone, min(u) AS u, min(n) AS n, count(*) AS n_over, avg(y) AS a0, avg(y * (m - i) / (m - 1)) AS a1 FROM i WHERE m >= 30 GROUP BY 1), g AS (SELECT *, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS scale FROM f WHERE a0 > 2 * a1),
t AS (SELECT zone, alpha, xi, scale / xi * (pow(alpha / (n_over / n), -xi) - 1) AS y, u, scale FROM g, a WHERE alpha < n_over / n),
c AS (SELECT zone, unnest([0.02, 0.25]::DOUBLE[]) AS alpha, unnest(quantile_cont(x, [0.98, 0.75])) AS cut FROM x GROUP BY zone), e AS (SELECT c.zone, c.alpha, avg(x.x) AS body FROM c JOIN x ON x.zone = c.zone AND x.x >= c.cut GROUP BY 1, 2)
SELECT e.zone, e.alpha, t.zone IS NOT NULL AS fitted, CASE WHEN t.zone IS NULL THEN round(body, 5) WHEN xi < 1 THEN round(u + y + (scale + xi * y) / (1 - xi), 5) ELSE 'inf'::DOUBLE END + 0.0 AS cvar FROM e LEFT JOIN t ON t.zone = e.zone AND t.alpha = e.alpha""",
)
def tail_mixture(spark, sf_dir):
    """The mean of the worst 2 % and 25 % of losses: by the fitted tail where the level lies within its share, by the data themselves beyond."""
    rows = zonal(spark, sf_dir).select("zone", (F.avg("p").over(Window.partitionBy("zone")) - F.col("p")).alias("x"))
    fit = tails.gpd_fit(tails.exceedances(rows, ["zone"], "x", 0.9), ["zone"]).filter("side = 1")
    levels = [F.struct(F.lit(a).alias("alpha"), tails.gpd_cvar(a).alias("tail")) for a in (0.02, 0.25)]
    told = fit.select("zone", F.explode(F.array(*levels)).alias("t")).select("zone", "t.*")
    body = [scores.value_at_risk(rows, ["zone"], "x", a).select("zone", F.lit(a).alias("alpha"), F.col("cvar").alias("body")) for a in (0.02, 0.25)]
    joined = body[0].unionByName(body[1]).join(told, ["zone", "alpha"], "left")
    return joined.select("zone", "alpha", F.col("tail").isNotNull().alias("fitted"), r(F.coalesce("tail", "body"), 5).alias("cvar"))


_JUMP_Z = [tails.normal_quantile_sql(f"u{k}") for k in range(4)]


@query(
    "jump_paths",
    """, d AS (SELECT zone, ts, p - lag(p) OVER (PARTITION BY zone ORDER BY ts) AS d FROM zonal), k AS (SELECT zone, ts, d FROM d WHERE d IS NOT NULL), u AS (SELECT zone, quantile_cont(abs(d), 0.95) AS u FROM k GROUP BY 1),
m AS (SELECT k.zone, stddev_pop(d) FILTER (abs(d) <= u) AS sd, count(*) FILTER (abs(d) > u) / count(*) AS rate, coalesce(avg(CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END) FILTER (abs(d) > u), 0) AS up, CASE WHEN count(*) FILTER (d > u) >= 30 THEN avg(ln(d)) FILTER (d > u) END AS um, CASE WHEN count(*) FILTER (d > u) >= 30 THEN stddev_pop(ln(d)) FILTER (d > u) END AS us, CASE WHEN count(*) FILTER (-d > u) >= 30 THEN avg(ln(-d)) FILTER (-d > u) END AS dm, CASE WHEN count(*) FILTER (-d > u) >= 30 THEN stddev_pop(ln(-d)) FILTER (-d > u) END AS ds FROM k JOIN u ON k.zone = u.zone GROUP BY 1),
s AS (SELECT m.*, ts, """
    + ", ".join(f"(('0x' || substr(md5(k.zone || strftime(ts, ' %Y-%m-%d %H:%M:%S') || '-{i}'), 1, 8))::BIGINT + 0.5) / 4294967296e0 AS u{i}" for i in range(4))
    + f" FROM k JOIN m ON m.zone = k.zone) SELECT zone, ts, round(sd * {_JUMP_Z[3]} + CASE WHEN u0 < rate THEN CASE WHEN u2 < up THEN coalesce(exp(um + us * {_JUMP_Z[1]}), 0) ELSE -coalesce(exp(dm + ds * {_JUMP_Z[1]}), 0) END ELSE 0 END, 5) + 0.0 AS change FROM s",
)
def jump_paths(spark, sf_dir):
    """A drawn change for each of a zone's hours by its own body and jumps."""
    rows = zonal(spark, sf_dir).select("zone", "ts", (F.col("p") - F.lag("p").over(Window.partitionBy("zone").orderBy("ts"))).alias("d")).filter("d is not null")
    seeds = rows.join(tails.jump_moments(rows, ["zone"], "d"), "zone").withColumn("seed", F.concat("zone", F.date_format("ts", " yyyy-MM-dd HH:mm:ss")))
    law = lambda side: (F.col(f"{side}_mean"), F.col(f"{side}_sd"))
    return tails.jump_path(seeds, "seed", F.col("body_sd"), F.col("jump_rate"), F.col("up_share"), law("up"), law("down")).select("zone", "ts", r("change", 5).alias("change"))


@query("drift_alarm")
def drift_alarm(spark, sf_dir):
    """The learner walks over errors that grow fourfold from the middle of each zone's time on; its coverage over the last 48 hours is watched,
    and 24 hours in a row far off target raise the alarm. Held against a plain walk in the tests."""
    rows = align.time_lag(zonal(spark, sf_dir), ["zone"], "p", 24, "pred").filter("pred is not null")
    ends = rows.groupBy("zone").agg(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b"))
    late = F.unix_timestamp("ts") >= (F.col("a") + F.col("b")) / 2
    drifted = rows.join(ends, "zone").select("zone", "ts", "pred", (F.col("pred") + F.when(late, 4).otherwise(1) * (F.col("p") - F.col("pred"))).alias("actual"))
    walked = online.conformal_intervals(drifted, "zone", window=168)
    last = Window.partitionBy("zone").orderBy("ts").rowsBetween(-47, 0)
    watched = walked.select("zone", "ts", F.when(F.count("hit").over(last) >= 48, F.avg(F.col("hit").cast("double")).over(last)).alias("coverage"))
    return online.refit_alarms(watched, ["zone"], "coverage", 0.9, 0.05, 24).select("zone", "start", "hours", "alarm")


@query(
    "scenario_coverage",
    """, f AS (SELECT day FROM whole GROUP BY 1), pl AS (SELECT DISTINCT f.day AS fr, ((dayofyear(f.day) - 1) % 365 + o + 365) % 365 AS place FROM f, (SELECT unnest(generate_series(-7, 7)) AS o)), pool AS (SELECT place, list(fr ORDER BY fr) AS pool FROM pl GROUP BY 1), w AS (SELECT f.day, pool, path FROM f JOIN pool ON place = (dayofyear(f.day) - 1) % 365, range(20) t(path)),
d AS (SELECT day, path, pool[CAST(floor("""
    + _DRAW.format(seed="'42-' || strftime(day, '%Y-%m-%d') || '-' || path")
    + """ * len(pool)) AS BIGINT) + 1] AS fr FROM w), v AS (SELECT d.day, h.hour, h.p FROM d JOIN whole h ON h.day = d.fr), q AS (SELECT day, hour, quantile_cont(p, [0.05, 0.25, 0.75, 0.95]) AS q FROM v GROUP BY 1, 2)
SELECT CAST(q.hour AS BIGINT) AS hour, round(avg(CASE WHEN w.p BETWEEN q[1] AND q[4] THEN 1e0 ELSE 0e0 END), 6) AS wide, round(avg(CASE WHEN w.p BETWEEN q[2] AND q[3] THEN 1e0 ELSE 0e0 END), 6) AS narrow FROM q JOIN whole w ON w.day = q.day AND w.hour = q.hour GROUP BY 1""",
)
def scenario_coverage(spark, sf_dir):
    """How often prices lie within the bands of drawn days, by hour."""
    rows = curves.complete_days(days(spark, sf_dir), ["day"]).select("day", "hour", "p")
    paths = panels.block_paths(rows.select("day", "hour"), rows, "p", 20)
    bands = paths.groupBy("day", "hour").agg(F.percentile("p", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.75, 0.95)])).alias("q"))
    inside = lambda a, b: r(F.avg(F.col("p").between(F.col("q")[a], F.col("q")[b]).cast("double")))
    return bands.join(rows, ["day", "hour"]).groupBy(F.col("hour").cast("long").alias("hour")).agg(inside(0, 3).alias("wide"), inside(1, 2).alias("narrow"))


_RULES = [{"type": "fixed", "month": 1, "day": 6}, {"type": "fixed", "month": 6, "day": 4}, {"type": "easter", "offset": 1}, {"type": "weekday", "month": 6, "day": 19, "weekday": "Fri"}]


@query(
    "configured_holidays",
    "-- rules\nWITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), "
    + HOLIDAY_STEPS
    + "SELECT make_date(y, 1, 6) AS day, 'fixed' AS kind FROM y UNION ALL SELECT make_date(y, 6, 4), 'fixed' FROM y UNION ALL SELECT CAST(easter + 1 AS DATE), 'easter' FROM e UNION ALL SELECT make_date(y, 6, 19) + CAST((5 - isodow(make_date(y, 6, 19)) + 7) % 7 AS INTEGER), 'weekday' FROM y",
)
def configured_holidays(spark, sf_dir):
    """Holidays of the years with orders by rules of a configuration: fixed days, days from Easter, weekdays from a day on."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return calendar.configured_holidays(years, _RULES).select("day", "kind")


@query("log_linear_train")
def log_linear_train(spark, sf_dir):
    """The log-linear model and its stretch; parts are held against numpy and a known law in the tests."""
    rows = _rows(spark, sf_dir)
    c = fits.ridge(rows, "y", ["a", "b"], 1.0, "weight", True)
    raw = rows.withColumn("raw", fits.log_linear(fits.dot(c), 55.0))
    scale, power = absolute.power_stretch(raw, "raw", "p", "weight")
    return spark.createDataFrame([(c["intercept"], c["a"], c["b"], scale, power)], "intercept double, a double, b double, scale double, power double")


@query("quantile_fits")
def quantile_fits(spark, sf_dir):
    """Lines through the 10 %, 50 % and 90 % quantiles; held against a search in the tests."""
    rows = pairs(spark, sf_dir)
    told = [(q, c["intercept"], c["pred"]) for q in (0.1, 0.5, 0.9) for c in [models.quantile_ridge(rows, "actual", ["pred"], q)]]
    return spark.createDataFrame(told, "level double, intercept double, slope double")


def _with_cycle(rows):
    return rows.withColumns({"s": F.sin(2 * F.pi() * F.hour("ts") / 24), "c": F.cos(2 * F.pi() * F.hour("ts") / 24)})


@query("arma_fit")
def arma_fit(spark, sf_dir):
    """ARMA(2, 1) of the hourly price with two inputs of the hour, by exact likelihood; held against a plain filter in the tests."""
    m = statespace.fit(_with_cycle(hourly(spark, sf_dir)), "p", ["s", "c"])
    return spark.createDataFrame([(k, float(v)) for k, v in m.items()], "name string, value double")


@query("arma_forecast")
def arma_forecast(spark, sf_dir):
    """The 168 hours behind the last one, by that model."""
    h = hourly(spark, sf_dir)
    m = statespace.fit(_with_cycle(h), "p", ["s", "c"])
    last = h.agg(F.max("ts").alias("last"))
    future = last.select("last", F.explode(F.sequence(F.lit(1), F.lit(168))).alias("step")).select("step", (F.col("last") + F.col("step") * F.expr("interval 1 hour")).alias("ts"))
    return statespace.forecast(_with_cycle(future), m, ["s", "c"])


@query("every_feature_set")
def every_feature_set(spark, sf_dir):
    """All 1,024 sets of ten features of the hourly price, each fitted on all days before and scored on each day from the eighth on."""
    rows = _with_cycle(pairs(spark, sf_dir)).join(wide(spark, sf_dir).select((F.col("ts") + F.expr("interval 24 hours")).alias("ts"), F.col("a").alias("za"), F.col("b").alias("zb"), F.col("c").alias("zc")), "ts", "left").na.fill(0.0, ["za", "zb", "zc"])
    rows = rows.withColumns({"s2": F.col("s") * F.col("c"), "c2": F.col("c") * F.col("c"), "weekend": (F.weekday("ts") > 4).cast("double"), "trend": F.unix_timestamp("ts") / 86_400 - 19_723})
    features = ["pred", "za", "zb", "zc", "s", "c", "s2", "c2", "weekend", "trend"]
    return subsets.every_set(rows, "actual", features, F.to_date("ts"), 1.0, 7)


@query("hedge_cvar")
def hedge_cvar(spark, sf_dir):
    """The hedge of a zone's changes by the zone average's, and by that and another zone's: least mean of the worst 5 % on the first 55 % of the
    hours, figures from the rest. Held against grid searches in the tests."""
    from gridloom.operators import hedge

    rows = wide(spark, sf_dir).join(hourly(spark, sf_dir), "ts").na.drop(subset=["a", "b", "p"])
    told = [(len(f), *(h.get(k) for k in ("ratio", "ratio_2", "threshold", "objective", "unhedged", "hedged", "saved_percent"))) for f in (["p"], ["p", "b"]) for h in [hedge.least_cvar(rows, "a", f, order="ts")]]
    return spark.createDataFrame(told, "features int, ratio double, ratio_2 double, threshold double, objective double, unhedged double, hedged double, saved_percent double")


@query("gpd_likelihood")
def gpd_likelihood(spark, sf_dir):
    """Each zone's tails by greatest likelihood over weekly origins of 14 days, and their 1 % mean; held against a fine search in the tests."""
    z = zonal(spark, sf_dir)
    rows = z.select("zone", (F.col("p") - F.avg("p").over(Window.partitionBy("zone"))).alias("x"), F.to_date("ts").alias("day"))
    origins = rows.select("zone", F.col("day").alias("origin")).filter(F.dayofmonth("origin") % 7 == 0).distinct()
    dealt = rows.select("zone", "x", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 14))).alias("origin")).join(origins, ["zone", "origin"], "left_semi")
    fit = tails.gpd_likelihood(tails.exceedances(dealt, ["zone", "origin"], "x", 0.85), ["zone", "origin"], 10)
    return fit.select("zone", "origin", "side", "n_over", r("xi", 5).alias("xi"), r("scale", 4).alias("scale"), r(tails.gpd_cvar(0.01), 4).alias("cvar"))


@query(
    "mapped_prices",
    _WIDE + """SELECT h.ts, round(1.2 * pow(greatest(h.p, 0) + 1e-10, 0.9), 6) AS power, round(-10 + 8 * ln(0.2 * greatest(h.p, 0) + 3), 6) AS log, round(20 * pow(ln(0.05 * greatest(h.p, 0) + 1), 1.5), 6) AS power_log, round(greatest(h.p, 0.6 * wd.a + 0.5 * wd.b), 6) AS floor, round(h.p + 0.4 * greatest(1.1 * (0.6 * wd.a + 0.4 * wd.b) - h.p, 0), 6) AS excess,
round(greatest(h.p + 0.2 * greatest(wd.a - 50, 0) + 0.1 * greatest(wd.b - 50, 0), 0), 6) AS threshold, round(greatest(h.p + 5 * pow(greatest(wd.a, 0) / 100 + 0.01, 1.5), 0), 6) AS coupled_power,
round(1 + 0.3 * wd.a + 0.5 * wd.b + 0.2 * (2 + 0.4 * wd.a + 0.4 * wd.b) + 0.1 * greatest(2 + 0.4 * wd.a + 0.4 * wd.b - 40, 0) - 0.05 * greatest(2 + 0.4 * wd.a + 0.4 * wd.b - 60, 0), 6) AS two_stage FROM wd JOIN hourly h ON h.ts = wd.ts WHERE wd.a IS NOT NULL AND wd.b IS NOT NULL""",
)
def mapped_prices(spark, sf_dir):
    """Three output maps, four couplings and a two-stage line at given parameters."""
    rows = wide(spark, sf_dir).join(hourly(spark, sf_dir), "ts").na.drop(subset=["a", "b"])
    p, a, b = F.col("p"), F.col("a"), F.col("b")
    out = {kind: searches.mapped(p, kind, v) for kind, v in (("power", [1.2, 0.9]), ("log", [-10.0, 8.0, 0.2, 3.0]), ("power_log", [20.0, 0.05, 1.5]))}
    out |= {form: searches.coupled(p, a, b, form, v) for form, v in (("floor", [0.6, 0.5]), ("excess", [0.4, 1.1]), ("threshold", [0.2, 50.0, 0.1]))}
    out["coupled_power"] = searches.coupled(p, a, b, "power", [5.0, 1.5])
    out["two_stage"] = searches.two_stage({"a": 0.4, "b": 0.4}, 2.0, [40.0, 60.0], {"a": 0.3, "b": 0.5}, 1.0, [0.1, -0.05], 0.2)
    return rows.select("ts", *[r(c).alias(n) for n, c in out.items()])


@query("fitted_maps")
def fitted_maps(spark, sf_dir):
    """Each output map and coupling, fitted, with its error over all rows; known laws are found in the tests."""
    rows = wide(spark, sf_dir).join(pairs(spark, sf_dir), "ts").na.drop(subset=["a", "b"])
    told = {k: searches.mapped(F.col("pred"), k, searches.fit_map(rows, "pred", "actual", k)) for k in ("power", "log", "power_log")}
    told |= {f"coupled_{f}": searches.coupled(F.col("pred"), F.col("a"), F.col("b"), f, searches.fit_coupling(rows, "pred", "a", "b", "actual", f)) for f in ("floor", "excess", "threshold", "power")}
    errors = rows.agg(*[F.avg(F.abs(F.col("actual") - c)).alias(n) for n, c in told.items()])
    return errors.select(F.explode(F.array(*[F.struct(F.lit(n).alias("form"), F.col(n).alias("mae")) for n in told])).alias("x")).select("x.*")
