"""Queries on layered forecasts and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import physics
from gridloom.operators import align, forecast, smooth, tails
from gridloom.operators import fits
from gridloom.operators.tails import normal_share_sql
from gridloom.plans.base import hourly, query, r, zonal
from gridloom.plans.feature_queries import BASE, holidays, weather
from gridloom.functions.features import base_features

COEFFICIENTS = {"intercept": 0.5, "price_lag": 0.3, "is_workday": 2.0, "wind_share": -20.0, "sun_effective": 0.01, "temp": -0.4, "is_holiday": -1.5}
TAILS = {"u0": 30.0, "mu": 0.5, "sigma": 12.0, "xi_r": 0.3, "scale_r": 15.0, "share_r": 0.06, "xi_l": 0.0, "scale_l": 10.0, "share_l": 0.03}
LEVELS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
_RHO = "(101325.0 / (287.05 * (temp + 273.15)))"


def _dev(name, source, hour="hour(ts)", day="isodow(ts)"):
    """SQL: a series' mean by hour, then by weekday of the rest."""
    return f"{name}_h AS (SELECT hour(ts) AS b, avg(x) AS m FROM {source} GROUP BY 1), {name}_d AS (SELECT isodow(ts) AS b, avg(x - m) AS m FROM {source} JOIN {name}_h ON b = hour(ts) GROUP BY 1)"


_LAYERS = (
    BASE
    + f""", ph AS (SELECT *, abs(p) AS sun, 1 / (1 + exp(-(wind - 7.5) / 1.5)) * {_RHO} / 1.225 AS ws, abs(p) * (1 - 0.004 * greatest(temp + 0.03 * abs(p) - 25, 0)) AS se FROM feat), s_p AS (SELECT ts, p AS x FROM ph), s_w AS (SELECT ts, ws AS x FROM ph), s_s AS (SELECT ts, se AS x FROM ph), """
    + ", ".join(_dev(n, f"s_{n}") for n in ("p", "w", "s"))
    + """, lg AS (SELECT ph.*, b.p - lh.m - ld.m AS price_lag, row_number() OVER (ORDER BY ph.ts) AS step FROM ph LEFT JOIN hourly b ON b.ts = ph.ts - INTERVAL 168 HOUR LEFT JOIN p_h lh ON lh.b = hour(b.ts) LEFT JOIN p_d ld ON ld.b = isodow(b.ts)),
lay AS (SELECT lg.ts, lg.p, step, p_h.m + p_d.m AS seasonal, 0.5 + 0.3 * coalesce(price_lag, 0) + 2 * is_workday - 20 * (ws - w_h.m - w_d.m) - 0.4 * (temp - (SELECT avg(temp) FROM ph)) - 1.5 * is_holiday AS linear, pow(0.95, step) * 8 AS decay
 FROM lg JOIN p_h ON p_h.b = hour(lg.ts) JOIN p_d ON p_d.b = isodow(lg.ts) JOIN w_h ON w_h.b = hour(lg.ts) JOIN w_d ON w_d.b = isodow(lg.ts)),
fc AS (SELECT *, -5 + greatest(seasonal + linear + decay + 5, 0) + ln(1 + exp(-abs(seasonal + linear + decay + 5))) AS mean FROM lay)
"""
)


def _parts(rows, value):
    return smooth.profile(rows, [], value, {"hour": (F.hour("ts"), 24), "day": (F.weekday("ts"), 7)})


def layers(spark, sf_dir):
    h = hourly(spark, sf_dir)
    rows = base_features(weather(spark, sf_dir), holidays(spark)).withColumn("sun", F.abs("p"))
    known = rows.select("ts", physics.wind_power(F.col("wind"), F.col("temp")).alias("wind_share"), physics.effective_irradiance(F.col("sun"), F.col("temp")).alias("sun_effective"))
    parts = {"wind_share": _parts(known, "wind_share"), "sun_effective": _parts(known, "sun_effective"), "price_lag": _parts(h, "p")}
    rows = align.time_lag(rows, [], "p", 168, "price_lag")
    first = h.agg(F.min("ts").alias("origin"))
    design = forecast.design(rows, parts).crossJoin(F.broadcast(first))
    # a row an hour without gaps, so the hours since the first are the steps
    design = design.withColumn("step", (F.unix_timestamp("ts") - F.unix_timestamp("origin")) / 3600 + 1)
    return forecast.layered(design, parts["price_lag"], COEFFICIENTS, 0.95, 8.0)


@query("layered_forecast", _LAYERS.replace("row_number() OVER (ORDER BY ph.ts) AS step", "(epoch(ph.ts) - epoch((SELECT min(ts) FROM hourly))) / 3600 + 1 AS step") + "SELECT ts, round(seasonal, 6) + 0.0 AS seasonal, round(linear, 6) + 0.0 AS linear, round(decay, 6) AS decay, round(mean, 6) + 0.0 AS mean FROM fc")
def layered_forecast(spark, sf_dir):
    """Seasonal level, linear part, decaying residual and their floored sum; the sun's positive coefficient counts as 0."""
    return layers(spark, sf_dir).select("ts", *[r(c).alias(c) for c in ("seasonal", "linear", "decay", "mean")])


def _shock_sql(u):
    z = tails.normal_quantile_sql(f"(({u}) - 0.03e0) / (1e0 - 0.03e0 - 0.06e0)")
    return f"(CASE WHEN ({u}) < 0.03e0 THEN -30 - (-10 * ln(({u}) / 0.03e0)) WHEN ({u}) > 1e0 - 0.06e0 THEN 30 + 15 / 0.3e0 * (pow((1 - ({u})) / 0.06e0, -0.3e0) - 1) ELSE greatest(least(0.5 + 12 * {z}, 30), -30) END)"


@query("fan_chart", ", x AS (SELECT a.ts, a.p AS mean FROM hourly a) SELECT ts, " + ", ".join(f"round(mean + {_shock_sql(str(u) + 'e0')}, 6) + 0.0 AS {n}" for n, u in LEVELS.items()) + " FROM x")
def fan_chart(spark, sf_dir):
    """Bands of a normal body with Pareto tails around each hour."""
    return forecast.with_bands(hourly(spark, sf_dir), "p", TAILS, LEVELS).select("ts", *[r(n).alias(n) for n in LEVELS])


@query(
    "shock_paths",
    ", u AS (SELECT zone, ts, (('0x' || substr(md5(zone || strftime(ts, ' %Y-%m-%d %H:%M:%S') || '-0'), 1, 8))::BIGINT + 0.5) / 4294967296e0 AS u FROM zonal) SELECT zone, ts, round(" + _shock_sql("u") + ", 6) + 0.0 AS shock FROM u",
)
def shock_paths(spark, sf_dir):
    """A drawn shock for each of a zone's hours."""
    seed = F.concat("zone", F.date_format("ts", " yyyy-MM-dd HH:mm:ss"))
    return zonal(spark, sf_dir).select("zone", "ts", r(forecast.shock_quantile(tails.uniform(seed, 0), TAILS)).alias("shock"))


_FILL = ["zero", "persist", "ar1", "oracle"]


@query(
    "neighbour_fill",
    """, o AS (SELECT zone, ts AS origin, p AS last FROM zonal WHERE hour(ts) = 6), m AS (SELECT zone, avg(p) AS m FROM zonal GROUP BY 1), x AS (SELECT z.zone, z.p, last, m, epoch(z.ts - o.origin) / 3600 AS lead FROM o JOIN zonal z ON z.zone = o.zone AND z.ts > o.origin AND z.ts <= o.origin + INTERVAL 24 HOUR JOIN m ON m.zone = o.zone),
e AS (SELECT unnest(['zero', 'persist', 'ar1', 'oracle']) AS kind, unnest([abs(p - m), abs(p - last), abs(p - m - pow(0.9, lead) * (last - m)), 0]) AS e FROM x) SELECT kind, count(*) AS n, round(avg(e), 6) AS mae FROM e GROUP BY 1""",
)
def neighbour_fill(spark, sf_dir):
    """How far four ways to fill a neighbour's next 24 hours lie off: origins are dealt to their hours."""
    z = zonal(spark, sf_dir)
    means = z.groupBy("zone").agg(F.avg("p").alias("mean"))
    origins = z.filter(F.hour("ts") == 6).select("zone", F.col("ts").alias("origin"), F.col("p").alias("last"), F.explode(F.sequence(F.lit(1), F.lit(24))).alias("lead"))
    ahead = origins.withColumn("ts", F.timestamp_add("HOUR", F.col("lead"), F.col("origin"))).join(z, ["zone", "ts"]).join(means, "zone")
    out = None
    for kind in _FILL:
        part = forecast.filled_lag(ahead, kind, "p", "last", "mean", 0.9, "lead").select(F.lit(kind).alias("kind"), F.abs(F.col("p") - F.col("filled")).alias("e"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"), r(F.avg("e")).alias("mae"))


@query(
    "lead_errors",
    ", o AS (SELECT ts AS origin, p - 50 AS e0 FROM hourly WHERE hour(ts) = 6), x AS (SELECT CAST(epoch(h.ts - o.origin) / 3600 AS BIGINT) AS lead, h.p AS actual, 50 + pow(0.97, epoch(h.ts - o.origin) / 3600) * e0 AS pred FROM o JOIN hourly h ON h.ts > o.origin AND h.ts <= o.origin + INTERVAL 168 HOUR) SELECT lead, count(*) AS n, round(avg(abs(actual - pred)), 6) AS mae, round(avg(actual - pred), 6) + 0.0 AS bias FROM x WHERE lead IN (1, 24, 48, 168) GROUP BY 1",
)
def lead_errors(spark, sf_dir):
    """Errors of a residual that dies away from each 6 o'clock, at four leads."""
    h = hourly(spark, sf_dir)
    origins = h.filter(F.hour("ts") == 6).select(F.col("ts").alias("origin"), (F.col("p") - 50).alias("e0"), F.explode(F.array(*[F.lit(k) for k in (1, 24, 48, 168)])).alias("lead"))
    ahead = origins.withColumn("ts", F.timestamp_add("HOUR", F.col("lead"), F.col("origin"))).join(h, "ts")
    error = F.col("p") - (50 + F.pow(F.lit(0.97), F.col("lead")) * F.col("e0"))
    return ahead.groupBy(F.col("lead").cast("long").alias("lead")).agg(F.count("*").alias("n"), r(F.avg(F.abs(error))).alias("mae"), r(F.avg(error)).alias("bias"))


_MODELS = [(k, 3.0 + 0.02 * k, 0.05, -0.01) for k in range(1, 7)]


@query(
    "duration_predict",
    BASE + ", m AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {i}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for k, i, a, b in _MODELS) + ") t(k, i, a, b)), d AS (SELECT ld AS day, avg(wind) AS wind, avg(temp) AS temp FROM feat GROUP BY 1) SELECT day, CAST(k AS BIGINT) AS k, round(exp(least(i + a * wind + b * temp, 20)) - 15, 6) AS price FROM d, m",
)
def duration_predict(spark, sf_dir):
    """Six sub-models of a day's weather, one for each level, read from a small table of coefficients."""
    rows = base_features(weather(spark, sf_dir), holidays(spark)).groupBy(F.col("local_day").alias("day")).agg(F.avg("wind").alias("wind"), F.avg("temp").alias("temp"))
    models = spark.createDataFrame(_MODELS, "k int, i double, a double, b double")
    linear = F.col("i") + F.col("a") * F.col("wind") + F.col("b") * F.col("temp")
    priced = F.exp(F.least(linear, F.lit(20.0))) - 15
    return rows.crossJoin(F.broadcast(models)).select("day", F.col("k").cast("long").alias("k"), r(priced).alias("price"))


@query(
    "kernel_cvar",
    ", l AS (SELECT zone, -p AS l FROM zonal), s AS (SELECT zone, count(*) AS n, stddev_pop(l) AS s, quantile_cont(l, 0.95) AS v FROM l GROUP BY 1), k AS (SELECT s.zone, v, 1.06 * s * pow(n, -0.2) AS w, l FROM l JOIN s ON s.zone = l.zone) SELECT zone, round(any_value(v) + avg((l - v) * " + normal_share_sql("((l - v) / w)") + " + w * exp(-0.5e0 * pow((l - v) / w, 2)) / sqrt(2 * pi())) / 0.05, 5) + 0.0 AS cvar FROM k GROUP BY zone",
)
def kernel_cvar(spark, sf_dir):
    """The smoothed mean of the worst 5 % at the quantile, with Silverman's width."""
    losses = zonal(spark, sf_dir).select("zone", (-F.col("p")).alias("l"))
    from gridloom.operators import hedge

    return hedge.kernel_cvar(losses, ["zone"], "l", 0.05).select("zone", r("cvar", 5).alias("cvar"))


@query("sun_modulator", ", x AS (SELECT ts, p AS y, 800 * greatest(sin(pi() * (hour(ts) - 5) / 14), 0) AS base, least(100, abs(p)) / 100 AS cloud FROM hourly), z AS (SELECT base AS a, base * cloud AS b, y FROM x WHERE base > 0), g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bz FROM z) SELECT round((bb * ay - ab * bz) / (aa * bb - ab * ab), 6) + 0.0 AS clear, round((aa * bz - ab * ay) / (aa * bb - ab * ab), 6) + 0.0 AS cloud FROM g")
def sun_modulator(spark, sf_dir):
    """Two parameters of sun power, for clear sky and for clouds, without a constant, from five sums."""
    base = 800 * F.greatest(F.sin(F.pi() * (F.hour("ts") - 5) / 14), F.lit(0.0))
    rows = hourly(spark, sf_dir).select(F.col("p").alias("y"), base.alias("a"), (base * F.least(F.lit(100.0), F.abs("p")) / 100).alias("b")).filter("a > 0")
    m = fits.matrix(fits.sums_of_products(rows, ["a", "b", "y"]).first()["m"], 4)
    import numpy as np

    c = np.linalg.lstsq(m[1:3, 1:3], m[1:3, 3], rcond=None)[0]
    return spark.createDataFrame([(round(float(c[0]), 6), round(float(c[1]), 6))], "clear double, cloud double")
