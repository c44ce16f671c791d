"""Queries on features of price models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import calendar, features, physics, tariff
from gridloom.plans.base import HOLIDAYS, LOCAL, hourly, query, r, zonal
from gridloom.session import table

#: Made-up weather and grid series, as SQL over hourly; ``weather`` is the same.
WEATHER = ", w AS (SELECT ts, p, abs(p) / 20 AS wind, p / 10 - 5 AS temp, least(1.0, abs(p) / 100) AS nuclear, 5000 + 20 * p AS consumption, 1000 + 10 * abs(p) AS wind_mw, 5 * abs(p) AS solar_mw FROM hourly)\n"


def weather(spark, sf_dir):
    p = F.col("p")
    return hourly(spark, sf_dir).select(
        "ts", "p", (F.abs(p) / 20).alias("wind"), (p / 10 - 5).alias("temp"), F.least(F.lit(1.0), F.abs(p) / 100).alias("nuclear"), (5000 + 20 * p).alias("consumption"), (1000 + 10 * F.abs(p)).alias("wind_mw"), (5 * F.abs(p)).alias("solar_mw")
    )


def holidays(spark):
    return calendar.holidays_between(spark, 2023, 2025)


def _bump(centre, width):
    return f"exp(-0.5 * pow((h - {centre}) / {width}, 2))"


BASE = (
    WEATHER
    + HOLIDAYS
    + f""", loc AS (SELECT w.*, hour({LOCAL}) AS h, month({LOCAL}) AS mo, CAST({LOCAL} AS DATE) AS ld, isodow({LOCAL}) AS dow FROM w),
cal AS (SELECT loc.*, CASE WHEN ld IN (SELECT day FROM hol) THEN 1e0 ELSE 0e0 END AS is_holiday, CASE WHEN dow < 6 AND ld NOT IN (SELECT day FROM hol) THEN 1e0 ELSE 0e0 END AS is_workday FROM loc),
feat AS (SELECT *, sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos, sin(2 * pi() * mo / 12) AS month_sin, cos(2 * pi() * mo / 12) AS month_cos, greatest(17 - temp, 0) ** 2 AS hdd_sq, ln(1 + greatest(8 - wind, 0)) AS wind_log_scarcity,
 greatest(6 - wind, 0) * {_bump(9, 1.8)} * is_workday AS calm_x_morning, greatest(6 - wind, 0) * {_bump(19, 2.0)} * is_workday AS calm_x_evening,
 greatest(5 - wind, 0) * greatest(17 - temp, 0) * greatest({_bump(9, 1.8)}, {_bump(19, 2.0)}) AS scarcity FROM cal)
"""
)
_BASE_NAMES = ["hour_sin", "hour_cos", "month_sin", "month_cos", "is_holiday", "is_workday", "hdd_sq", "wind_log_scarcity", "calm_x_morning", "calm_x_evening", "scarcity"]


@query("base_features", BASE + "SELECT ts, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _BASE_NAMES) + " FROM feat")
def base_features(spark, sf_dir):
    """Cycles, workday, heating and scarcity of each hour."""
    return features.base_features(weather(spark, sf_dir), holidays(spark)).select("ts", *[r(c).alias(c) for c in _BASE_NAMES])


_GRID = ", net AS (SELECT *, (consumption - wind_mw - solar_mw - nuclear * 4372) / 1000 AS gw, greatest(1 - nuclear, 0) AS deficit FROM feat)\n"


@query(
    "grid_features",
    BASE + _GRID + "SELECT ts, round(deficit + 1e-9, 6) AS nuclear_deficit, round(deficit * scarcity, 6) AS nuclear_x_scarcity, round(gw, 6) AS net_load_gw, round((gw - (SELECT avg(gw) FROM net)) ** 2, 6) AS net_load_squared, round(gw * is_workday, 6) + 0.0 AS net_load_x_workday, round(gw * scarcity, 6) + 0.0 AS net_load_x_scarcity FROM net",
)
def grid_features(spark, sf_dir):
    """Nuclear and net-load features of each hour."""
    rows = features.net_load_features(features.nuclear_features(features.base_features(weather(spark, sf_dir), holidays(spark))))
    names = ["nuclear_deficit", "nuclear_x_scarcity", "net_load_gw", "net_load_squared", "net_load_x_workday", "net_load_x_scarcity"]
    return rows.select("ts", *[r(F.col(c) + (1e-9 if c == "nuclear_deficit" else 0)).alias(c) for c in names])


@query(
    "capacity_features",
    WEATHER + """, c AS (SELECT *, max(nuclear) OVER (PARTITION BY month(ts) ORDER BY ts ROWS 1439 PRECEDING) AS cap FROM w), d AS (SELECT ts, cap - nuclear AS deficit, (cap - nuclear) * ln(1 + greatest(8 - wind, 0)) AS tight FROM c)
SELECT ts, round(deficit, 6) + 0.0 AS deficit, round(tight - (SELECT avg(tight) FROM d), 6) + 0.0 AS tight_centred FROM d""",
)
def capacity_features(spark, sf_dir):
    """What nuclear output lacks of its highest of the last 60 days (within the month), and that by wind scarcity, centred."""
    last = Window.partitionBy(F.month("ts")).orderBy("ts").rowsBetween(-1439, 0)
    rows = weather(spark, sf_dir).withColumn("deficit", F.max("nuclear").over(last) - F.col("nuclear"))
    rows = rows.withColumn("tight", F.col("deficit") * F.log1p(features.over(-F.col("wind"), -8.0)))
    return features.centred(rows, ["tight"]).select("ts", r("deficit").alias("deficit"), r("tight_centred").alias("tight_centred"))


@query(
    "neighbour_forms",
    """, z AS (SELECT zone, ts, p, p - avg(p) OVER (PARTITION BY zone) AS raw, p - avg(p) OVER (PARTITION BY zone, hour(ts)) AS seasonal FROM zonal), b AS (SELECT ts, p FROM zonal WHERE zone = (SELECT min(event_type) FROM events))
SELECT z.zone, z.ts, round(raw, 6) + 0.0 AS raw, round(seasonal, 6) + 0.0 AS seasonal, round(z.p - b.p, 6) + 0.0 AS spread FROM z JOIN b ON z.ts = b.ts""",
)
def neighbour_forms(spark, sf_dir):
    """Each zone's price about its mean, about its hour's mean, and against the first zone on shared hours."""
    z = zonal(spark, sf_dir)
    first = table(spark, sf_dir, "events").agg(F.min("event_type").alias("zone"))
    base = z.join(F.broadcast(first), "zone").select("ts", F.col("p").alias("base"))
    rows = features.centred(z, ["p"], ["zone"]).withColumnRenamed("p_centred", "raw").withColumn("hour", F.hour("ts"))
    rows = features.centred(rows, ["p"], ["zone", "hour"]).join(base, "ts")
    return rows.select("zone", "ts", r("raw").alias("raw"), r("p_centred").alias("seasonal"), r(F.col("p") - F.col("base")).alias("spread"))


@query(
    "interaction_features",
    WEATHER + """, m AS (SELECT avg(nuclear) AS n, avg(wind) AS v, avg(consumption) AS c, stddev_pop(consumption) AS s FROM w)
SELECT ts, round((nuclear - n) * (wind - v), 6) + 0.0 AS nuclear_x_wind, round((consumption - c) / s, 6) + 0.0 AS consumption_z, round((nuclear - n) * (consumption - c) / s, 6) + 0.0 AS nuclear_x_consumption FROM w, m""",
)
def interaction_features(spark, sf_dir):
    """Products of centred series; consumption in standard deviations (0 where it doesn't vary)."""
    rows = features.centred(weather(spark, sf_dir), ["nuclear", "wind", "consumption"])
    spread = rows.agg(F.stddev_pop("consumption").alias("s"))
    z = F.coalesce(F.try_divide(F.col("consumption_centred"), F.col("s")), F.lit(0.0))
    n = F.col("nuclear_centred")
    return rows.crossJoin(F.broadcast(spread)).select("ts", r(n * F.col("wind_centred")).alias("nuclear_x_wind"), r(z).alias("consumption_z"), r(n * z).alias("nuclear_x_consumption"))


@query(
    "stabilised_prices",
    """, a AS (SELECT median(p) AS a FROM hourly), b AS (SELECT a, 1.4826 * median(abs(p - a)) AS b FROM hourly, a GROUP BY a)
SELECT ts, round(asinh((p - a) / b), 6) + 0.0 AS asinh, round(ln(p + 20), 6) AS log, round(p, 6) AS back FROM hourly, b""",
)
def stabilised_prices(spark, sf_dir):
    """Prices by both transforms, and back by the first."""
    rows = hourly(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(features.stabiliser(rows, "p")))
    a, b = F.col("a"), F.col("b")
    y = features.stabilised(F.col("p"), "asinh", a, b)
    return rows.select("ts", r(y).alias("asinh"), r(features.stabilised(F.col("p"), "log", a, b)).alias("log"), r(features.restored(y, "asinh", a, b)).alias("back"))


_DUMMIES = [f"off{k}" for k in (1, 12, 23)] + [f"work{k}" for k in (1, 12, 23)]


@query(
    "calendar_dummies",
    BASE
    + "SELECT ts, CAST(24 * (dow - 1) + h AS BIGINT) AS hour_of_week, is_workday = 0 AS off_day, "
    + ", ".join(f"CASE WHEN is_workday = {0 if c.startswith('off') else 1} AND h = {c.removeprefix('off').removeprefix('work')} THEN 1e0 ELSE 0e0 END AS {c}" for c in _DUMMIES)
    + ", round(sin(2 * pi() * (dayofyear(ld) - 1) / 365.25), 6) + 0.0 AS year_sin1, round(cos(2 * pi() * 2 * (dayofyear(ld) - 1) / 365.25), 6) + 0.0 AS year_cos2 FROM cal",
)
def calendar_dummies(spark, sf_dir):
    """Hour by off-day marks (23 a side are made, six are shown), the hour of the week, and terms of the year."""
    rows = features.with_calendar(weather(spark, sf_dir), holidays(spark))
    hour, work = F.col("local_hour"), F.col("is_workday") == 1
    marks = [*features.one_hot(F.when(~work, hour).otherwise(-1), 24, "off"), *features.one_hot(F.when(work, hour).otherwise(-1), 24, "work")]
    year = calendar.fourier((F.dayofyear("local_day") - 1) / 365.25, 2, "year")
    rows = rows.select("ts", (24 * F.weekday("local_day") + hour).cast("long").alias("hour_of_week"), (~work).alias("off_day"), *marks, *year)
    return rows.select("ts", "hour_of_week", "off_day", *_DUMMIES, r("year_sin1").alias("year_sin1"), r("year_cos2").alias("year_cos2"))


@query("ring_distance", "-- ring\nSELECT DISTINCT CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(least(abs(dayofyear(o_orderdate) - 15), 365 - abs(dayofyear(o_orderdate) - 15)) AS BIGINT) AS days FROM orders")
def ring_distance(spark, sf_dir):
    """Days around the year to the 15th day."""
    doy = table(spark, sf_dir, "orders").select(F.dayofyear("o_orderdate").cast("long").alias("doy")).distinct()
    return doy.select("doy", calendar.ring_distance(F.col("doy"), F.lit(15)).cast("long").alias("days"))


@query("floor_curve", "SELECT zone, ts, round(p - 50, 6) + 0.0 AS price, round(-5 + greatest(p - 45, 0) + ln(1 + exp(-abs(p - 45))), 6) + 0.0 AS floored FROM zonal")
def floor_curve(spark, sf_dir):
    """Each zone's price, lowered by 50, above a soft floor of -5."""
    rows = zonal(spark, sf_dir).withColumn("x", F.col("p") - 50)
    return rows.select("zone", "ts", r("x").alias("price"), r(physics.soft_floor(F.col("x"))).alias("floored"))


@query(
    "panel_corrections",
    ", g AS (SELECT ts, p, (hour(ts) % 5) * 22.5e0 AS t, ((day(ts) * 24 + hour(ts)) * 15 % 360)::DOUBLE AS a FROM hourly) SELECT ts, round(t, 6) AS tilt, round(a, 6) AS azimuth, round(least(greatest(p / 1000 * 5 * 0.85 * greatest(least(1 - 0.0006 * (t - 45) ** 2, 1.05), 0.6) * greatest(cos(radians(abs(a - 180)) / 2), 0.4), 0), 4.25), 6) AS kwh FROM g",
)
def panel_corrections(spark, sf_dir):
    """Each hour's price read as irradiance, and what panels of a tilt and azimuth that turn with the hours would yield."""
    rows = hourly(spark, sf_dir).withColumns({"tilt": (F.hour("ts") % 5) * 22.5, "azimuth": F.pmod((F.dayofmonth("ts") * 24 + F.hour("ts")) * 15, F.lit(360)).cast("double")})
    return rows.select("ts", "tilt", "azimuth", r(physics.tilted_kwh(F.col("p"), 5.0, F.col("tilt"), F.col("azimuth"))).alias("kwh"))


@query(
    "cloud_modulators",
    WEATHER + ", k AS (SELECT ts, least(100, abs(p)) AS cloud, 800 * greatest(sin(pi() * (hour(ts) - 5) / 14), 0) AS clear FROM w) SELECT ts, round(1 - 0.75 * pow(cloud / 100, 3.4), 6) AS kasten, round(1 - 0.7 * cloud / 100 + 1e-9, 6) AS linear, round(greatest(0.95 - 0.8 * cloud / 100, 0.15) + 1e-9, 6) AS floored, round(greatest(10 + 2.5 * clear * (1 - 0.75 * pow(cloud / 100, 3.4)), 0), 6) AS mw FROM k",
)
def cloud_modulators(spark, sf_dir):
    """What clouds leave of clear sky in three forms, and the solar MW of the first."""
    cloud = F.least(F.lit(100.0), F.abs("p"))
    clear = 800 * F.greatest(F.sin(F.pi() * (F.hour("ts") - 5) / 14), F.lit(0.0))
    form = lambda name, **kw: physics.cloud_modulator(cloud, name, **kw)
    return weather(spark, sf_dir).select(
        "ts", r(form("kasten_czeplak")).alias("kasten"), r(form("linear", slope=0.7) + 1e-9).alias("linear"), r(form("affine_floor", start=0.95, slope=0.8, floor=0.15) + 1e-9).alias("floored"), r(physics.solar_mw(clear, form("kasten_czeplak"), 10.0, 2.5)).alias("mw")
    )


@query(
    "site_clear_sky",
    """, s AS (SELECT * FROM (VALUES (60.17, 24.94, 2.0), (65.01, 25.47, 1.0)) t(lat, lon, weight)), g AS (SELECT ts, 2 * pi() * (epoch(ts) - epoch(date_trunc('year', ts))) / (epoch(date_trunc('year', ts) + INTERVAL 1 YEAR) - epoch(date_trunc('year', ts))) AS g FROM hourly),
d AS (SELECT ts, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS m FROM g),
c AS (SELECT ts, weight, greatest(sin(radians(lat)) * sin(d) + cos(radians(lat)) * cos(d) * cos(radians(15 * (hour(ts) + lon / 15 + m / 60 - 12))), 0) AS c FROM d, s)
SELECT ts, round(sum(weight * CASE WHEN c > 0 THEN 1098 * c * exp(-0.057 / c) ELSE 0 END) / sum(weight), 6) AS ghi FROM c GROUP BY ts""",
)
def site_clear_sky(spark, sf_dir):
    """Clear-sky irradiance of two sites, weighted."""
    sites = spark.createDataFrame([(60.17, 24.94, 2.0), (65.01, 25.47, 1.0)], "lat double, lon double, weight double")
    return physics.site_irradiance(hourly(spark, sf_dir), sites).select("ts", r("ghi").alias("ghi"))


@query(
    "tariff_forms",
    f", x AS (SELECT ts, p - 100 AS spot, CASE WHEN hour({LOCAL}) < 7 OR hour({LOCAL}) >= 22 THEN 0.02 ELSE 0.035 END AS t, greatest(sin(pi() * (hour(ts) - 5) / 14), 0) * 3 AS pv FROM hourly), b AS (SELECT ts, pv, (spot / 1000 + 0.004 + t + 0.02253) * 1.255 AS buy, spot / 1000 - 0.003 AS sell FROM x) SELECT ts, round(buy, 7) + 0.0 AS buy, round((1 - least(greatest(pv / 1.2, 0), 1)) * buy + least(greatest(pv / 1.2, 0), 1) * sell, 7) + 0.0 AS blended FROM b",
)
def tariff_forms(spark, sf_dir):
    """The price that isn't held at zero, and buy and sell blended by what panels give of a demand of 1.2 kWh."""
    spot = F.col("p") - 100
    night = calendar.is_night_tariff(calendar.local(F.col("ts")))
    rows = hourly(spark, sf_dir).select("ts", tariff.consumer_price(spot, F.when(night, 0.02).otherwise(0.035), clamp=False).alias("buy"), tariff.sell_price(spot).alias("sell"), (F.greatest(F.sin(F.pi() * (F.hour("ts") - 5) / 14), F.lit(0.0)) * 3).alias("pv"))
    return rows.select("ts", r("buy", 7).alias("buy"), r(tariff.blended_price(F.col("buy"), F.col("sell"), F.col("pv"), F.lit(1.2)), 7).alias("blended"))
