"""Queries on calendars, physics, tariffs, curves and alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import calendar, physics, tariff
from gridloom.operators import align, curves
from gridloom.plans.base import HOLIDAY_STEPS, days, hourly, query, r, zonal
from gridloom.session import table

_RANK = """, ranked AS (SELECT day, hour, p, row_number() OVER (PARTITION BY day ORDER BY p, hour) AS up, row_number() OVER (PARTITION BY day ORDER BY p DESC, hour) AS down,
 avg(p) OVER (PARTITION BY day ORDER BY p, hour ROWS UNBOUNDED PRECEDING) AS cheap, avg(p) OVER (PARTITION BY day ORDER BY p DESC, hour ROWS UNBOUNDED PRECEDING) AS peak FROM whole)
"""


def _curves(spark, sf_dir, most=12):
    return curves.duration_curves(curves.complete_days(days(spark, sf_dir), ["day"]), ["day"], most)


@query("dk_curves", _RANK + "SELECT c.day, c.up AS k, round(c.cheap, 6) AS cheap, round(d.peak, 6) AS peak FROM ranked c JOIN ranked d ON c.day = d.day AND c.up = d.down WHERE c.up <= 12")
def dk_curves(spark, sf_dir):
    """Mean of the k cheapest and dearest hours of each whole day."""
    return _curves(spark, sf_dir).select("day", F.col("k").cast("long").alias("k"), r("cheap").alias("cheap"), r("peak").alias("peak"))


@query("dk_inverse", _RANK + "SELECT day, up AS k, round(p, 6) AS price FROM ranked WHERE up <= 12")
def dk_inverse(spark, sf_dir):
    """Sorted prices back from the curve of means."""
    return curves.sorted_prices(_curves(spark, sf_dir), ["day"], "cheap").select("day", F.col("k").cast("long").alias("k"), r("price").alias("price"))


@query("dk_monotone", _RANK + """, s AS (SELECT day, cheap - lag(cheap) OVER (PARTITION BY day ORDER BY up) AS step, NULL AS fall FROM ranked
 UNION ALL SELECT day, NULL, peak - lag(peak) OVER (PARTITION BY day ORDER BY down) FROM ranked)
SELECT day, bool_and(step IS NULL OR step >= -1e-9) AS cheap_rises, bool_and(fall IS NULL OR fall <= 1e-9) AS peak_falls FROM s GROUP BY day""")
def dk_monotone(spark, sf_dir):
    """Whether each day's curves are monotone."""
    before = lambda c: F.coalesce(F.lag(c).over(Window.partitionBy("day").orderBy("k")), F.col(c))
    steps = _curves(spark, sf_dir, 24).select("day", (F.col("cheap") >= before("cheap") - 1e-9).alias("up"), (F.col("peak") <= before("peak") + 1e-9).alias("down"))
    return steps.groupBy("day").agg(F.bool_and("up").alias("cheap_rises"), F.bool_and("down").alias("peak_falls"))


@query("duration_scalars", _RANK + "SELECT day, round(max(CASE WHEN up = 1 THEN cheap END), 6) AS d1, round(max(CASE WHEN up = 4 THEN cheap END), 6) AS d4, round(max(CASE WHEN up = 8 THEN cheap END), 6) AS d8, round(max(CASE WHEN up = 12 THEN cheap END), 6) AS d12 FROM ranked GROUP BY day")
def duration_scalars(spark, sf_dir):
    """The 1, 4, 8 and 12 hour means in columns."""
    at = lambda k: r(F.max(F.when(F.col("k") == k, F.col("cheap")))).alias(f"d{k}")
    return _curves(spark, sf_dir).groupBy("day").agg(*[at(k) for k in (1, 4, 8, 12)])


def _pava_sql(sign):
    return f""", v AS (SELECT day, hour, {sign} * p AS v FROM whole),
m AS (SELECT i.day, i.hour AS i, j.hour AS j, avg(x.v) AS m FROM v i JOIN v j ON i.day = j.day AND i.hour <= j.hour JOIN v x ON x.day = i.day AND x.hour BETWEEN i.hour AND j.hour GROUP BY ALL),
l AS (SELECT k.day, k.hour, m.i, min(m.m) AS least FROM v k JOIN m ON m.day = k.day AND m.i <= k.hour AND m.j >= k.hour GROUP BY ALL)
SELECT day, hour, round({sign} * max(least), 6) + 0.0 AS fitted FROM l GROUP BY day, hour"""


def _pava(increasing):
    def run(spark, sf_dir):
        whole = curves.complete_days(days(spark, sf_dir), ["day"])
        return curves.isotonic(whole, ["day"], "hour", "p", increasing).select("day", F.col("hour").cast("long").alias("hour"), r("fitted").alias("fitted"))

    return run


query("pava_increasing", _pava_sql(1).replace("SELECT day, hour, round", "SELECT day, CAST(hour AS BIGINT) AS hour, round"))(_pava(True))
query("pava_decreasing", _pava_sql(-1).replace("SELECT day, hour, round", "SELECT day, CAST(hour AS BIGINT) AS hour, round"))(_pava(False))


@query("cheapest_block", """, b AS (SELECT day, hour AS start, avg(p) OVER w AS mean, count(p) OVER w AS n FROM whole WINDOW w AS (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT day, CAST(arg_min(start, (mean, start)) AS BIGINT) AS start, round(min(mean), 6) AS mean FROM b WHERE n = 4 GROUP BY day""")
def cheapest_block(spark, sf_dir):
    """The cheapest run of four hours of each whole day."""
    whole = curves.complete_days(days(spark, sf_dir), ["day"])
    return curves.cheapest_block(whole, ["day"]).select("day", F.col("start").cast("long").alias("start"), r("mean").alias("mean"))


_LOCAL = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Helsinki')"
_NIGHT = f"(hour({_LOCAL}) < 7 OR hour({_LOCAL}) >= 22)"
_BUY = f"((greatest(p - 100, 0) / 1000 + 0.004 + CASE WHEN {_NIGHT} THEN 0.02 ELSE 0.035 END + 0.02253) * 1.255)"
_SELL = "((p - 100) / 1000 - 0.003)"


def _buy_sell(spark, sf_dir):
    """Hours with spot (the series less 100, so that some are negative), buy and sell prices."""
    spot = hourly(spark, sf_dir).withColumn("spot", F.col("p") - 100)
    transfer = F.when(calendar.is_night_tariff(calendar.local(F.col("ts"))), 0.02).otherwise(0.035)
    return spot.select("ts", "spot", tariff.consumer_price(F.col("spot"), transfer).alias("buy"), tariff.sell_price(F.col("spot")).alias("sell"))


@query("consumer_price", f"SELECT ts, round({_BUY}, 9) AS buy, round({_SELL}, 9) + 0.0 AS sell FROM hourly")
def consumer_price(spark, sf_dir):
    """Buy and sell price of each hour, by local day and night."""
    return _buy_sell(spark, sf_dir).select("ts", r("buy", 9).alias("buy"), r("sell", 9).alias("sell"))


@query("effective_price", f""", x AS (SELECT ts, {_BUY} AS buy, {_SELL} AS sell, greatest(sin(pi() * (hour(ts) - 5) / 14), 0) * 3 AS pv FROM hourly)
SELECT ts, round(least(greatest(pv - 0.4, 0), 1) * least(sell, 0) + (1 - least(greatest(pv - 0.4, 0), 1)) * buy, 9) + 0.0 AS marginal,
 round(greatest(1.2 - pv, 0) * buy - greatest(pv - 1.2, 0) * sell, 9) + 0.0 AS cost FROM x""")
def effective_price(spark, sf_dir):
    """What one more kWh and what a load of 1.2 kWh cost with panels."""
    pv = F.greatest(F.sin(F.pi() * (F.hour("ts") - 5) / 14), F.lit(0.0)) * 3
    rows = _buy_sell(spark, sf_dir).withColumn("pv", pv)
    own = [F.col(c) for c in ("buy", "sell", "pv")]
    return rows.select("ts", r(tariff.marginal_price(*own, F.lit(0.4)), 9).alias("marginal"), r(tariff.net_cost(*own, F.lit(1.2)), 9).alias("cost"))


@query("week_stats", "SELECT CAST(isoyear(ts) AS BIGINT) AS year, CAST(weekofyear(ts) AS BIGINT) AS week, round(min(p), 6) AS low, round(avg(p), 6) AS mean, round(max(p), 6) AS high FROM hourly GROUP BY 1, 2")
def week_stats(spark, sf_dir):
    """Least, mean and greatest price of each ISO week."""
    week = hourly(spark, sf_dir).groupBy(F.expr("extract(YEAROFWEEK FROM ts)").cast("long").alias("year"), F.weekofyear("ts").cast("long").alias("week"))
    return week.agg(r(F.min("p")).alias("low"), r(F.avg("p")).alias("mean"), r(F.max("p")).alias("high"))


@query("local_calendar", f"SELECT ts, CAST({_LOCAL} AS DATE) AS local_day, CAST(hour({_LOCAL}) AS BIGINT) AS local_hour, CAST(isodow(ts) - 1 AS BIGINT) AS weekday, isodow({_LOCAL}) < 6 AS workday, {_NIGHT} AS night FROM hourly")
def local_calendar(spark, sf_dir):
    """Local day and hour, UTC weekday, workday and night flags."""
    at = calendar.local(F.col("ts"))
    return hourly(spark, sf_dir).select("ts", F.to_date(at).alias("local_day"), F.hour(at).cast("long").alias("local_hour"), F.weekday("ts").cast("long").alias("weekday"), calendar.is_workday(at).alias("workday"), calendar.is_night_tariff(at).alias("night"))


_EASTER = "-- holidays\nWITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),\n" + HOLIDAY_STEPS


def _order_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()


@query("finnish_holidays", _EASTER + "SELECT day FROM hol")
def finnish_holidays(spark, sf_dir):
    """Every holiday of the years that orders cover."""
    return calendar.holidays(_order_years(spark, sf_dir))


@query("holiday_orders", _EASTER + "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT day FROM hol) GROUP BY 1")
def holiday_orders(spark, sf_dir):
    """Orders placed on holidays: a semi join on a table of a few days a year."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return orders.join(calendar.holidays(_order_years(spark, sf_dir)), "day", "left_semi").groupBy("day").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("daylight_hours", "-- days\nSELECT DISTINCT CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, round(24 / pi() * acos(greatest(least(-tan(radians(62.0)) * tan(radians(23.45) * sin(2 * pi() * (dayofyear(o_orderdate) + 284) / 365.0)), 1), -1)), 6) AS hours FROM orders")
def daylight_hours(spark, sf_dir):
    """Day length at 62 degrees north."""
    doy = table(spark, sf_dir, "orders").select(F.dayofyear("o_orderdate").alias("doy")).distinct()
    return doy.select(F.col("doy").cast("long").alias("doy"), r(calendar.daylight_hours(F.col("doy")), 6).alias("hours"))


@query("calendar_fourier", "SELECT ts, " + ", ".join(f"round({f}(2 * pi() * {k} * hour(ts) / 24.0), 6) + 0.0 AS day_{f}{k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM hourly")
def calendar_fourier(spark, sf_dir):
    """Two orders of Fourier terms over the day."""
    names = [f"day_{f}{k}" for k in (1, 2) for f in ("sin", "cos")]
    rows = hourly(spark, sf_dir).select("ts", *calendar.fourier(F.hour("ts") / 24, 2, "day"))
    return rows.select("ts", *[r(F.col(c), 6).alias(c) for c in names])


_RHO = "(101325.0 / (287.05 * (t + 273.15)))"


@query("weather_power", f""", w AS (SELECT ts, abs(p) / 20 AS v, p / 10 - 5 AS t, abs(p) AS g FROM hourly)
SELECT ts, round({_RHO}, 6) AS density, round(1 / (1 + exp(-(v - 7.5) / 1.5)) * {_RHO} / 1.225, 6) AS wind, round({_RHO} * v ** 3, 6) AS cubed,
 round(g * (1 - 0.004 * greatest(t + 0.03 * g - 25, 0)), 6) AS sun, round(least(greatest(g / 1000 * 5 * 0.85, 0), 4.25) + 1e-9, 6) AS panels FROM w""")
def weather_power(spark, sf_dir):
    """Air density, wind and sun power from made-up weather."""
    w = hourly(spark, sf_dir).select("ts", (F.abs("p") / 20).alias("v"), (F.col("p") / 10 - 5).alias("t"), F.abs("p").alias("g"))
    v, t, g = F.col("v"), F.col("t"), F.col("g")
    return w.select("ts", r(physics.air_density(t), 6).alias("density"), r(physics.wind_power(v, t), 6).alias("wind"), r(physics.wind_cubed(v, t)).alias("cubed"), r(physics.effective_irradiance(g, t)).alias("sun"), r(physics.panel_kwh(g, 5.0) + 1e-9, 6).alias("panels"))


_SUN = """, g AS (SELECT ts, 2 * pi() * (epoch(ts) - epoch(date_trunc('year', ts))) / (epoch(date_trunc('year', ts) + INTERVAL 1 YEAR) - epoch(date_trunc('year', ts))) AS g FROM hourly),
d AS (SELECT ts, g, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d,
 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS m FROM g),
z AS (SELECT ts, greatest(sin(radians(60.17)) * sin(d) + cos(radians(60.17)) * cos(d) * cos(radians(15 * (hour(ts) + 24.94 / 15 + m / 60 - 12))), 0) AS c,
 1367 * (1.00011 + 0.034221 * cos(g) + 0.00128 * sin(g) + 0.000719 * cos(2 * g) + 0.000077 * sin(2 * g)) AS top FROM d),
a AS (SELECT ts, c, top, CASE WHEN c > 0 THEN 1 / (c + 0.50572 * pow(96.07995 - degrees(acos(c)), -1.6364)) END AS am FROM z)
SELECT ts, round(c, 6) AS cosine, CASE WHEN c > 0 THEN round(1098 * c * exp(-0.057 / c), 6) ELSE 0 END AS haurwitz,
 CASE WHEN c > 0 THEN round(0.868 * top * c * exp(-0.0387 * am * [2.4, 2.5, 2.7, 2.9, 3.1, 3.3, 3.5, 3.4, 3.0, 2.7, 2.5, 2.4][month(ts)]) * exp(0.01 * pow(am, 1.8)), 6) ELSE 0 END AS ineichen FROM a"""


@query("clear_sky", _SUN)
def clear_sky(spark, sf_dir):
    """The sun's zenith cosine and two clear-sky irradiances at 60.17 N, 24.94 E."""
    sky = hourly(spark, sf_dir).select("ts", physics.zenith_cosine(F.col("ts"), 60.17, 24.94).alias("c"), physics.extraterrestrial(F.col("ts")).alias("top"))
    c = F.col("c")
    return sky.select("ts", r(c, 6).alias("cosine"), r(physics.haurwitz(c)).alias("haurwitz"), r(physics.ineichen(c, F.col("top"), physics.monthly_turbidity(F.col("ts")))).alias("ineichen"))


@query("soft_floor", "SELECT ts, round(-5 + greatest(p - 100 + 5, 0) + ln(1 + exp(-abs(p - 100 + 5))), 6) + 0.0 AS floored FROM hourly")
def soft_floor(spark, sf_dir):
    """Prices above a soft floor."""
    return hourly(spark, sf_dir).select("ts", r(physics.soft_floor(F.col("p") - 100)).alias("floored"))


@query("three_hour_resample", "SELECT time_bucket(INTERVAL 3 HOUR, ts) AS ts, round(avg(p), 6) AS mean, round(max(p), 6) AS high, count(*) AS hours FROM hourly GROUP BY 1")
def three_hour_resample(spark, sf_dir):
    """Means and maxima of three hours."""
    return hourly(spark, sf_dir).groupBy(F.window("ts", "3 hours").alias("w")).agg(r(F.avg("p")).alias("mean"), r(F.max("p")).alias("high"), F.count("*").alias("hours")).select(F.col("w.start").alias("ts"), "mean", "high", "hours")


@query("gap_ranges", """, n AS (SELECT zone, ts, lead(ts) OVER (PARTITION BY zone ORDER BY ts) AS nx FROM zonal)
SELECT zone, ts + INTERVAL 1 HOUR AS gap_start, date_diff('hour', ts, nx) - 1 AS gap_hours FROM n WHERE date_diff('hour', ts, nx) > 1""")
def gap_ranges(spark, sf_dir):
    """Runs of missing hours of each zone."""
    return align.gap_ranges(zonal(spark, sf_dir), ["zone"])


@query("keep_last_dedup", "-- latest\nSELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def keep_last_dedup(spark, sf_dir):
    """The last event of each user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return align.latest(rows, ["user_id"], "ts", "event_id").select("user_id", "event_id", r("value").alias("value"))


@query("coverage_stats", "-- coverage\nSELECT event_type AS zone, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 6) AS null_share FROM events GROUP BY 1")
def coverage_stats(spark, sf_dir):
    """Rows, range and share of nulls of each series."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("zone")).agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"), F.round(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)), 6).alias("null_share"))


@query("align_inner", "SELECT a.ts, round(a.p, 6) AS price, round(b.p, 6) AS other, round(a.p - b.p, 6) + 0.0 AS spread FROM hourly a JOIN zonal b ON a.ts = b.ts AND b.zone = (SELECT min(event_type) FROM events)")
def align_inner(spark, sf_dir):
    """The series beside its first zone, on common hours."""
    z = zonal(spark, sf_dir)
    first = table(spark, sf_dir, "events").agg(F.min("event_type").alias("zone"))
    own = z.join(first, "zone", "left_semi").select("ts", F.col("p").alias("other"))
    return hourly(spark, sf_dir).join(own, "ts").select("ts", r("p").alias("price"), r("other").alias("other"), r(F.col("p") - F.col("other")).alias("spread"))


@query("ffill_grid", """, b AS (SELECT zone, min(ts) AS lo, max(ts) AS hi FROM zonal GROUP BY 1), g AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b)
SELECT g.zone, g.ts, round(z.p, 6) AS p FROM g ASOF JOIN zonal z ON g.zone = z.zone AND g.ts >= z.ts""")
def ffill_grid(spark, sf_dir):
    """Every hour of each zone, missing ones filled from before."""
    return align.forward_fill(zonal(spark, sf_dir), ["zone"], "p").select("zone", "ts", r("p").alias("p"))


@query("asof_join", """, q AS (SELECT zone, ts FROM zonal), e AS (SELECT event_type AS zone, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT q.zone, q.ts, e.event_id FROM q ASOF LEFT JOIN e ON q.zone = e.zone AND q.ts >= e.ts""")
def asof_join(spark, sf_dir):
    """The last event of the zone before each of its hours."""
    right = table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_id").alias("tie"))
    return align.as_of(zonal(spark, sf_dir).select("zone", "ts"), right, ["zone"], "event_id", "tie")


@query("interval_join", """-- intervals
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 5 AS INTEGER) AS b, o_totalprice AS x FROM orders),
d AS (SELECT CAST(unnest(generate_series(a::TIMESTAMP, (b - 1)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day, x FROM o)
SELECT day, count(*) AS active, round(sum(x), 2) AS total FROM d GROUP BY day""")
def interval_join(spark, sf_dir):
    """What is open on each day, of orders open for one to five days."""
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(day.alias("a"), F.date_add(day, (1 + F.col("o_orderkey") % 5).cast("int")).alias("b"), "o_totalprice")
    return align.active_per_day(rows, "a", "b", "o_totalprice").select("day", "active", F.round("total", 2).alias("total"))


for _hours in (24, 168):

    @query(f"lag_{_hours}", f"SELECT a.zone, a.ts, round(b.p, 6) AS past FROM zonal a LEFT JOIN zonal b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL {_hours} HOUR")
    def _lag(spark, sf_dir, hours=_hours):
        """The price so many hours before, by time."""
        return align.time_lag(zonal(spark, sf_dir), ["zone"], "p", hours, "past").select("zone", "ts", r("past").alias("past"))


@query("weighted_avg_sites", "-- weighted\nSELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted, count(*) AS n FROM lineitem GROUP BY 1")
def weighted_avg_sites(spark, sf_dir):
    """Means weighted by quantity, a day."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(r(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("weighted"), F.count("*").alias("n"))


@query("unreconciled_anti", "SELECT a.zone, a.ts FROM zonal a WHERE NOT EXISTS (SELECT 1 FROM zonal b WHERE b.zone = a.zone AND b.ts = a.ts + INTERVAL 24 HOUR)")
def unreconciled_anti(spark, sf_dir):
    """Forecasts (a day ahead) that no actual has met."""
    z = zonal(spark, sf_dir).select("zone", "ts")
    return z.join(z.select("zone", (F.col("ts") - F.expr("interval 24 hours")).alias("ts")), ["zone", "ts"], "left_anti")


@query("actual_over_forecast", "SELECT coalesce(a.ts, f.ts) AS ts, round(coalesce(a.p, f.p), 6) AS p, CASE WHEN a.ts IS NULL THEN 'forecast' ELSE 'actual' END AS origin FROM hourly a FULL JOIN (SELECT ts + INTERVAL 24 HOUR AS ts, p FROM hourly) f ON a.ts = f.ts")
def actual_over_forecast(spark, sf_dir):
    """Actuals where there are any, forecasts elsewhere."""
    a = hourly(spark, sf_dir).select("ts", F.col("p").alias("a"))
    f = hourly(spark, sf_dir).select((F.col("ts") + F.expr("interval 24 hours")).alias("ts"), F.col("p").alias("f"))
    return a.join(f, "ts", "full").select("ts", r(F.coalesce("a", "f")).alias("p"), F.when(F.col("a").isNull(), "forecast").otherwise("actual").alias("origin"))
