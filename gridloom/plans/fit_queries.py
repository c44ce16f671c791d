"""Queries on fits from aggregated sums: weights, ridges, recursions, walk-forward, tails' moments."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.operators import fits, scores, tails
from gridloom.plans.base import hourly, pairs, query, r, zonal

#: Hours with a target (log of price + 55) and two features, and the weights of a half-life of ten days.
_ROWS = """, x AS (SELECT ts, p, ln(greatest(p + 55, 1)) AS y, sin(2 * pi() * hour(ts) / 24) AS a, CAST(isodow(ts) AS DOUBLE) AS b FROM hourly),
e AS (SELECT *, exp(-ln(2.0) / 240 * (epoch((SELECT max(ts) FROM x)) - epoch(ts)) / 3600) AS e FROM x), w AS (SELECT *, e * (SELECT count(*) FROM e) / (SELECT sum(e) FROM e) AS w FROM e)
"""


def _rows(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("ts", "p", F.ln(F.greatest(F.col("p") + 55, F.lit(1.0))).alias("y"), F.sin(2 * F.pi() * F.hour("ts") / 24).alias("a"), (F.weekday("ts") + 1).cast("double").alias("b"))
    return fits.time_weights(rows, 10)


@query("time_weights", _ROWS + "SELECT ts, round(w, 9) AS weight FROM w")
def time_weights(spark, sf_dir):
    """Weights halved every ten days."""
    return _rows(spark, sf_dir).select("ts", r("weight", 9).alias("weight"))


_SUMS = """, m AS (SELECT sum(w) AS n, sum(w * a) / sum(w) AS a0, sum(w * b) / sum(w) AS b0, sum(w * y) / sum(w) AS y0 FROM w),
g AS (SELECT any_value(n) AS n, any_value(a0) AS a0, any_value(b0) AS b0, any_value(y0) AS y0, sum(w * (a - a0) ** 2) AS aa, sum(w * (a - a0) * (b - b0)) AS ab, sum(w * (b - b0) ** 2) AS bb, sum(w * (a - a0) * (y - y0)) AS ay, sum(w * (b - b0) * (y - y0)) AS bz FROM w, m)
"""
_SCALED = ", s AS (SELECT *, sqrt(aa / n) AS sa, sqrt(bb / n) AS sb FROM g), t AS (SELECT *, aa / sa / sa + 1 AS l11, ab / sa / sb AS l12, bb / sb / sb + 1 AS l22, ay / sa AS r1, bz / sb AS r2 FROM s), f AS (SELECT a0, b0, y0, (l22 * r1 - l12 * r2) / (l11 * l22 - l12 * l12) / sa AS ca, (l11 * r2 - l12 * r1) / (l11 * l22 - l12 * l12) / sb AS cb FROM t)\n"


@query("weighted_ridge", _ROWS + _SUMS + _SCALED + "SELECT round(ca, 6) + 0.0 AS a, round(cb, 6) + 0.0 AS b, round(y0 - a0 * ca - b0 * cb, 6) + 0.0 AS intercept FROM f")
def weighted_ridge(spark, sf_dir):
    """Weighted ridge on features in standard deviations, told in the features' own units."""
    c = fits.ridge(_rows(spark, sf_dir), "y", ["a", "b"], 1.0, "weight", True)
    return spark.createDataFrame([(round(c["a"], 6), round(c["b"], 6), round(c["intercept"], 6))], "a double, b double, intercept double")


@query(
    "log_linear_predict",
    _ROWS + _SUMS + _SCALED + "SELECT ts, round(CASE WHEN exp(least(v, 20)) - 55 > 0 THEN 1.1 * pow(exp(least(v, 20)) - 55, 0.9) ELSE 0 END, 6) AS pred FROM (SELECT ts, y0 - a0 * ca - b0 * cb + ca * a + cb * b AS v FROM w, f)",
)
def log_linear_predict(spark, sf_dir):
    """That fit's prices, stretched by a scale and a power."""
    rows = _rows(spark, sf_dir)
    c = fits.ridge(rows, "y", ["a", "b"], 1.0, "weight", True)
    return rows.select("ts", r(fits.log_linear(fits.dot(c), 55.0, 1.1, 0.9)).alias("pred"))


@query(
    "signed_ridge",
    _ROWS + _SUMS + ", u AS (SELECT *, ((bb + 1) * ay - ab * bz) / ((aa + 1) * (bb + 1) - ab * ab) AS ca, ((aa + 1) * bz - ab * ay) / ((aa + 1) * (bb + 1) - ab * ab) AS cb FROM g), f AS (SELECT a0, b0, y0, least(ca, -0.5) AS ca, CASE WHEN ca > -0.5 THEN (bz + 0.5 * ab) / (bb + 1) ELSE cb END AS cb FROM u) SELECT round(ca, 6) + 0.0 AS a, round(cb, 6) + 0.0 AS b, round(y0 - a0 * ca - b0 * cb, 6) + 0.0 AS intercept FROM f",
)
def signed_ridge(spark, sf_dir):
    """A ridge whose first coefficient may not be above -0.5."""
    c = fits.ridge(_rows(spark, sf_dir), "y", ["a", "b"], 1.0, "weight", upper={"a": -0.5})
    return spark.createDataFrame([(round(c["a"], 6), round(c["b"], 6), round(c["intercept"], 6))], "a double, b double, intercept double")


_ALPHAS = (0.0, 10.0, 1000.0)


@query(
    "grid_scan",
    f""", t AS (SELECT count(*) * 0.55 AS cut FROM pairs), n AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM pairs), s AS (SELECT n.*, i <= cut AS train FROM n, t), m AS (SELECT avg(pred) AS x0, avg(actual) AS y0 FROM s WHERE train),
g AS (SELECT any_value(x0) AS x0, any_value(y0) AS y0, sum((pred - x0) ** 2) AS xx, sum((pred - x0) * (actual - y0)) AS xy FROM s, m WHERE train), v AS (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in _ALPHAS)}]) AS alpha)
SELECT alpha, round(xy / (xx + alpha), 6) + 0.0 AS slope, round(avg(abs(actual - y0 - xy / (xx + alpha) * (pred - x0))), 6) AS mae FROM s, g, v WHERE NOT train GROUP BY alpha, xy, xx""",
)
def grid_scan(spark, sf_dir):
    """Ridges of three penalties, fitted on the first 55 % of rows from one matrix of sums and scored on the rest in one pass."""
    marked = scores.in_order(pairs(spark, sf_dir), "ts", "i", "n").withColumn("train", F.col("i") + 1 <= F.col("n") * 0.55)
    sums = fits.matrix(fits.sums_of_products(marked.filter("train"), ["pred", "actual"]).first()["m"], 3)
    each = {a: fits.ridge_of(sums, [1], 2, a) for a in _ALPHAS}
    variants = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(float(b[1])).alias("slope"), (F.lit(float(b[0])) + float(b[1]) * F.col("pred")).alias("fit")) for a, b in each.items()])
    scored = marked.filter("not train").select("actual", F.explode(variants).alias("v")).select("actual", "v.*")
    return scored.groupBy("alpha").agg(r(F.first("slope")).alias("slope"), r(F.avg(F.abs(F.col("actual") - F.col("fit")))).alias("mae"))


_DEVIATIONS = f""", loc AS (SELECT zone, ts, p, hour(ts) AS h, isodow(ts) < 6 AS work FROM zonal), dev AS (SELECT *, avg(p) OVER (PARTITION BY zone, h, work) AS profile, p - avg(p) OVER (PARTITION BY zone, h, work) AS d FROM loc),
l AS (SELECT *, lag(d, 1) OVER (PARTITION BY zone ORDER BY ts) AS d1, lag(d, 2) OVER (PARTITION BY zone ORDER BY ts) AS d2 FROM dev),
g AS (SELECT zone, sum(d1 * d1) AS aa, sum(d1 * d2) AS ab, sum(d2 * d2) AS bb, sum(d1 * d) AS ay, sum(d2 * d) AS bz FROM l WHERE d2 IS NOT NULL GROUP BY 1),
f AS (SELECT zone, CASE WHEN abs(aa * bb - ab * ab) < 1e-9 THEN 0.7 ELSE (ay * bb - bz * ab) / (aa * bb - ab * ab) END AS p1, CASE WHEN abs(aa * bb - ab * ab) < 1e-9 THEN 0 ELSE (bz * aa - ay * ab) / (aa * bb - ab * ab) END AS p2 FROM g),
q AS (SELECT zone, p1, p2, CASE WHEN p1 * p1 + 4 * p2 >= 0 THEN (abs(p1) + sqrt(abs(p1 * p1 + 4 * p2))) / 2 ELSE sqrt(abs(p2)) END AS root FROM f),
phi AS (SELECT zone, p1 * CASE WHEN root > 0.3 THEN 0.3 / root ELSE 1 END AS phi1, p2 * CASE WHEN root > 0.3 THEN 0.3 / root ELSE 1 END AS phi2 FROM q)
"""


def _deviations(spark, sf_dir):
    profile = Window.partitionBy("zone", F.hour("ts"), calendar.is_workday(F.col("ts")))
    return zonal(spark, sf_dir).withColumn("profile", F.avg("p").over(profile)).withColumn("d", F.col("p") - F.col("profile"))


@query("ar2_fit", _DEVIATIONS + "SELECT zone, round(phi1, 6) + 0.0 AS phi1, round(phi2, 6) + 0.0 AS phi2 FROM phi")
def ar2_fit(spark, sf_dir):
    """AR(2) of each zone's deviations from its profile by hour and workday, its larger root held at 0.3."""
    return fits.ar2(_deviations(spark, sf_dir), ["zone"], "d", 0.3).select("zone", r("phi1").alias("phi1"), r("phi2").alias("phi2"))


@query("ar2_feature", _DEVIATIONS + "SELECT l.zone, l.ts, round((profile + phi1 * coalesce(d1, 0) + phi2 * coalesce(d2, 0)) / 100, 7) + 0.0 AS ar FROM l JOIN phi ON l.zone = phi.zone")
def ar2_feature(spark, sf_dir):
    """One step ahead by that recursion, in hundreds."""
    rows, order = _deviations(spark, sf_dir), Window.partitionBy("zone").orderBy("ts")
    phi = fits.ar2(rows, ["zone"], "d", 0.3)
    last = lambda k: F.coalesce(F.lag("d", k).over(order), F.lit(0.0))
    known = rows.select("zone", "ts", "profile", last(1).alias("d1"), last(2).alias("d2")).join(phi, "zone")
    return known.select("zone", "ts", r((F.col("profile") + F.col("phi1") * F.col("d1") + F.col("phi2") * F.col("d2")) / 100, 7).alias("ar"))


@query(
    "ar2_forecast",
    _DEVIATIONS
    + """, last AS (SELECT zone, arg_max(d, ts) AS d1, arg_max(d1, ts) AS d2 FROM l GROUP BY 1),
rec AS (WITH RECURSIVE rec AS (SELECT last.zone, 0 AS step, d1 AS a, d2 AS b FROM last UNION ALL SELECT rec.zone, step + 1, phi1 * a + phi2 * b, a FROM rec JOIN phi ON rec.zone = phi.zone WHERE step < 24) SELECT * FROM rec)
SELECT zone, CAST(step AS BIGINT) AS step, round(a, 6) + 0.0 AS d FROM rec WHERE step > 0""",
)
def ar2_forecast(spark, sf_dir):
    """The next 24 deviations of each zone."""
    rows, order = _deviations(spark, sf_dir), Window.partitionBy("zone").orderBy("ts")
    ends = rows.select("zone", "ts", "d", F.lag("d").over(order).alias("before")).groupBy("zone").agg(F.max_by(F.struct("d", "before"), "ts").alias("x"))
    path = fits.recursion(F.col("x.d"), F.col("x.before"), F.col("phi1"), F.col("phi2"), 24)
    out = ends.join(fits.ar2(rows, ["zone"], "d", 0.3), "zone").select("zone", F.posexplode(path).alias("step", "d"))
    return out.select("zone", (F.col("step") + 1).cast("long").alias("step"), r("d").alias("d"))


@query(
    "walk_forward",
    """, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(pred) AS x, sum(actual) AS y, sum(pred * pred) AS xx, sum(pred * actual) AS xy FROM pairs GROUP BY 1),
c AS (SELECT day, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT day, (xy - x * y / n) / (xx - x * x / n) AS slope, y / n - (xy - x * y / n) / (xx - x * x / n) * x / n AS level FROM c WHERE n >= 72)
SELECT f.day, round(avg(abs(actual - level - slope * pred)), 6) AS mae, count(*) AS n FROM pairs JOIN f ON f.day = CAST(pairs.ts AS DATE) GROUP BY 1""",
)
def walk_forward(spark, sf_dir):
    """A line refitted each day on all days before (72 rows at least): daily sums, added up in order, joined back by day."""
    rows = pairs(spark, sf_dir).withColumn("day", F.to_date("ts"))
    daily = rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("pred").alias("x"), F.sum("actual").alias("y"), F.sum(F.col("pred") * F.col("pred")).alias("xx"), F.sum(F.col("pred") * F.col("actual")).alias("xy"))
    before = Window.partitionBy().orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    sums = daily.select("day", *[F.sum(c).over(before).alias(c) for c in ("n", "x", "y", "xx", "xy")]).filter("n >= 72")
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    slope = F.try_divide(F.col("xy") - x * y / n, F.col("xx") - x * x / n)
    fit = sums.select("day", slope.alias("slope"), (y / n - slope * x / n).alias("level"))
    error = F.abs(F.col("actual") - F.col("level") - F.col("slope") * F.col("pred"))
    return rows.join(fit, "day").groupBy("day").agg(r(F.avg(error)).alias("mae"), F.count("*").alias("n"))


@query(
    "orthogonal_remainder",
    ", c AS (SELECT regr_slope(actual, pred) AS s, regr_intercept(actual, pred) AS l FROM pairs WHERE day(ts) <= 15) SELECT ts, round(actual - l - s * pred, 6) + 0.0 AS remainder, round(CASE WHEN hour(ts) * 8 <= 42 THEN 1 ELSE pow(0.5, (hour(ts) * 8 - 42) / 48.0) END, 6) AS weight FROM pairs, c",
)
def orthogonal_remainder(spark, sf_dir):
    """What a line fitted on the months' first halves leaves, and a weight that fades with lead."""
    rows = fits.remainder(pairs(spark, sf_dir), "actual", "pred", F.dayofmonth("ts") <= 15)
    return rows.select("ts", r("remainder").alias("remainder"), r(fits.faded(F.hour("ts") * 8.0, 42.0, 48.0)).alias("weight"))


@query(
    "ar1_decay",
    ", e AS (SELECT a.zone, a.ts, a.p - 50 AS e, b.p - 50 AS l FROM zonal a JOIN zonal b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 1 HOUR), f AS (SELECT zone, greatest(least(sum(e * l) / sum(l * l), 0.999), -0.999) AS phi, arg_max(e, ts) AS last FROM e GROUP BY 1) SELECT zone, CAST(h AS BIGINT) AS step, round(pow(phi, h) * last, 6) + 0.0 AS eta FROM f, (SELECT unnest([1, 2, 6, 24]) AS h)",
)
def ar1_decay(spark, sf_dir):
    """How the last residual (about 50) dies away by an AR(1) without a constant."""
    from gridloom.operators.align import time_lag

    rows = time_lag(zonal(spark, sf_dir).withColumn("e", F.col("p") - 50), ["zone"], "e", 1, "l").filter("l is not null")
    phi = F.greatest(F.least(F.coalesce(F.try_divide(F.sum(F.col("e") * F.col("l")), F.sum(F.col("l") * F.col("l"))), F.lit(0.0)), F.lit(0.999)), F.lit(-0.999))
    fit = rows.groupBy("zone").agg(phi.alias("phi"), F.max_by("e", "ts").alias("last")).withColumn("step", F.explode(F.array(*[F.lit(h) for h in (1, 2, 6, 24)])))
    return fit.select("zone", F.col("step").cast("long").alias("step"), r(F.pow("phi", F.col("step")) * F.col("last")).alias("eta"))


@query(
    "jump_moments",
    """, d AS (SELECT zone, p - lag(p) OVER (PARTITION BY zone ORDER BY ts) AS d FROM zonal), k AS (SELECT zone, d FROM d WHERE d IS NOT NULL), u AS (SELECT zone, quantile_cont(abs(d), 0.95) AS u FROM k GROUP BY 1)
SELECT k.zone, round(any_value(u), 6) AS u, round(stddev_pop(d) FILTER (abs(d) <= u), 6) AS body_sd, round(count(*) FILTER (abs(d) > u) / count(*), 6) AS jump_rate, round(coalesce(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FILTER (abs(d) > u), 0), 6) AS up_share, CASE WHEN count(*) FILTER (d > u) >= 30 THEN round(avg(ln(d)) FILTER (d > u), 6) END AS up_mean, CASE WHEN count(*) FILTER (d > u) >= 30 THEN round(stddev_pop(ln(d)) FILTER (d > u), 6) END AS up_sd, CASE WHEN count(*) FILTER (-d > u) >= 30 THEN round(avg(ln(-d)) FILTER (-d > u), 6) END AS down_mean, CASE WHEN count(*) FILTER (-d > u) >= 30 THEN round(stddev_pop(ln(-d)) FILTER (-d > u), 6) END AS down_sd FROM k JOIN u ON k.zone = u.zone GROUP BY 1""",
)
def jump_moments(spark, sf_dir):
    """Body and jumps of hourly changes: spread, rate, share upwards, and a log-normal size for each side that jumps often enough."""
    order = Window.partitionBy("zone").orderBy("ts")
    changes = zonal(spark, sf_dir).select("zone", (F.col("p") - F.lag("p").over(order)).alias("d")).filter("d is not null")
    m = tails.jump_moments(changes, ["zone"], "d")
    return m.select("zone", *[r(c).alias(c) for c in ("u", "body_sd", "jump_rate", "up_share", "up_mean", "up_sd", "down_mean", "down_sd")])


@query(
    "mean_excess",
    """, u AS (SELECT zone, unnest(generate_series(0, 9)) AS k, unnest(quantile_cont(p, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS u FROM zonal GROUP BY zone)
SELECT u.zone, CAST(k AS BIGINT) AS k, round(any_value(u), 6) AS u, round(avg(p - u), 6) AS excess, count(*) AS n FROM u JOIN zonal z ON z.zone = u.zone AND z.p > u.u GROUP BY u.zone, k""",
)
def mean_excess(spark, sf_dir):
    """How far prices above each of ten quantiles lie above it on average."""
    levels = [0.5 + 0.05 * k for k in range(10)]
    return tails.mean_excess(zonal(spark, sf_dir), ["zone"], "p", levels).select("zone", F.col("k").cast("long").alias("k"), r("u").alias("u"), r("excess").alias("excess"), "n")


@query(
    "residual_coupling",
    """, z AS (SELECT event_type AS zone, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), w AS (SELECT ts, max(p) FILTER (i = 1) AS y, max(p) FILTER (i = 2) AS a, max(p) FILTER (i = 3) AS b FROM zonal JOIN z USING (zone) GROUP BY 1), x AS (SELECT * FROM w WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n, round((covar_pop(a, y) * var_pop(b) - covar_pop(b, y) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2), 6) + 0.0 AS first, round((covar_pop(b, y) * var_pop(a) - covar_pop(a, y) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2), 6) + 0.0 AS second FROM x""",
)
def residual_coupling(spark, sf_dir):
    """Least squares of the first zone's price on two others', on hours that all three have."""
    z = zonal(spark, sf_dir)
    names = [x["zone"] for x in z.select("zone").distinct().orderBy("zone").limit(3).collect()]
    wide = z.groupBy("ts").pivot("zone", names).agg(F.max("p")).toDF("ts", "y", "a", "b").na.drop()
    m = fits.matrix(fits.sums_of_products(wide, ["a", "b", "y"]).first()["m"], 4)
    c = fits.ridge_of(m, [1, 2], 3)
    return spark.createDataFrame([(int(m[0, 0]), round(float(c[1]), 6), round(float(c[2]), 6))], "n long, first double, second double")
