"""Queries on panels, households and their cost over drawn paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import panels, tails, verify
from gridloom.plans.base import LOCAL, days, hourly, query, r
from gridloom.streaming import online

_MONTHS = [1.3, 1.2, 1.1, None, 0.9, 0.8, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2]
_MONTHS_SQL = "[" + ", ".join("1.0" if m is None else str(m) for m in _MONTHS) + "]::DOUBLE[]"
_SHAPE = """, sh AS (SELECT i // 24 AS wd, i % 24 AS hh, (0.6 + 0.5 * exp(-pow((i % 24 - 8) / 2.5, 2)) + 0.9 * exp(-pow((i % 24 - 19) / 3.0, 2))) * CASE WHEN i // 24 >= 5 THEN 1.1 ELSE 1.0 END AS raw FROM range(168) t(i)),
shape AS (SELECT wd, hh, raw / (SELECT avg(raw) FROM sh) AS share FROM sh)
"""
#: Hours with load, prices per kWh and panel yield.
_HOUSE = _SHAPE + f""", house AS (SELECT ts, CAST(ts AS DATE) AS day, hour(ts) AS hour, 9000 / 8760.0 * share * ({_MONTHS_SQL})[month({LOCAL})] AS load, (p + 40) / 1000 AS buy, (p - 20) / 1000 AS sell,
 greatest(sin(pi() * (hour(ts) - 5) / 14), 0) * 2.5 AS pv FROM hourly JOIN shape ON wd = isodow({LOCAL}) - 1 AND hh = hour({LOCAL}))
"""


def house(spark, sf_dir):
    rows = panels.load(hourly(spark, sf_dir), panels.synthetic_shape(spark), _MONTHS, 9000.0)
    pv = F.greatest(F.sin(F.pi() * (F.hour("ts") - 5) / 14), F.lit(0.0)) * 2.5
    return rows.select("ts", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "load", ((F.col("p") + 40) / 1000).alias("buy"), ((F.col("p") - 20) / 1000).alias("sell"), pv.alias("pv"))


@query("household_load", _HOUSE + "SELECT ts, round(load, 6) AS load FROM house")
def household_load(spark, sf_dir):
    """A load profile by local weekday, hour and month; a month without a factor counts as 1."""
    return house(spark, sf_dir).select("ts", r("load").alias("load"))


@query("load_shape", _SHAPE + "SELECT h.ts, round(share, 6) AS share FROM hourly h JOIN shape ON shape.wd = isodow(h.ts) - 1 AND shape.hh = hour(h.ts)")
def load_shape(spark, sf_dir):
    """The made-up shape at each hour of the prices, by weekday and hour."""
    rows = hourly(spark, sf_dir).withColumns({"weekday": F.weekday("ts"), "hour": F.hour("ts")})
    return rows.join(panels.synthetic_shape(spark), ["weekday", "hour"]).select("ts", r("share").alias("share"))


@query(
    "daily_household_cost",
    _HOUSE + "SELECT day, round(sum(greatest(load - pv, 0) * buy - greatest(pv - load, 0) * sell), 6) AS cost, round(sum(load), 6) AS kwh, round(sum(pv), 6) AS pv, round(sum(least(pv, load)), 6) AS own, round(sum(greatest(pv - load, 0)), 6) AS exported, round(sum(greatest(load - pv, 0)), 6) AS imported, round(avg(buy), 6) AS buy, round(sum(greatest(load - pv, 0) * buy - greatest(pv - load, 0) * sell) / sum(load), 6) AS per_kwh, round(least(sum(least(pv, load)) / greatest(sum(pv), 1e-9), 1), 6) AS own_share FROM house GROUP BY day",
)
def daily_household_cost(spark, sf_dir):
    """A day's cost, energy flows and own use."""
    from gridloom.functions import tariff

    cost = F.sum(tariff.net_cost(*[F.col(c) for c in ("buy", "sell", "pv", "load")]))
    own, out, bought = F.sum(F.least("pv", "load")), F.sum(F.greatest(F.col("pv") - F.col("load"), F.lit(0.0))), F.sum(F.greatest(F.col("load") - F.col("pv"), F.lit(0.0)))
    named = {"cost": cost, "kwh": F.sum("load"), "pv": F.sum("pv"), "own": own, "exported": out, "imported": bought, "buy": F.avg("buy"), "per_kwh": F.try_divide(cost, F.sum("load")), "own_share": F.least(own / F.greatest(F.sum("pv"), F.lit(1e-9)), F.lit(1.0))}
    return house(spark, sf_dir).groupBy("day").agg(*[r(c).alias(n) for n, c in named.items()])


@query(
    "load_strategies",
    _HOUSE + ", m AS (SELECT *, avg(load) OVER (PARTITION BY day) AS mean FROM house) SELECT day, round(sum(load * buy), 6) AS shaped, round(sum(mean * buy), 6) AS flat, round(sum(greatest(2 * mean - load, 0) * buy), 6) AS anti, round(sum(greatest(0.05, 20 / 24.0 * coalesce([1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2][month(ts)], 1))), 6) AS base FROM m GROUP BY day",
)
def load_strategies(spark, sf_dir):
    """What a day's load costs as it is, flat, and turned around; and a base load."""
    mean = F.avg("load").over(Window.partitionBy("day"))
    rows = house(spark, sf_dir).withColumn("mean", mean)
    cost = lambda kind: r(F.sum(panels.strategy(F.col("load"), F.col("mean"), kind) * F.col("buy"))).alias(kind)
    base = panels.base_load(20.0, F.month("ts"), [m or 1.0 for m in _MONTHS])
    return rows.groupBy("day").agg(cost("shaped"), cost("flat"), cost("anti"), r(F.sum(base)).alias("base"))


_DRAW = "(('0x' || substr(md5({seed} || '-0'), 1, 8))::BIGINT + 0.5) / 4294967296e0"
_PATHS = (
    _HOUSE
    + ", n AS (SELECT min(day) AS d0 FROM house), lead AS (SELECT house.*, least(date_diff('day', d0, day) % 8, 6) AS lead FROM house, n), c AS (SELECT *, [0.0, 0.0, 0.10, 0.15, 0.20, 0.25, 0.30][lead + 1]::DOUBLE AS rel FROM lead),"
    + f"""
dr AS (SELECT c.*, path, {_DRAW.format(seed="'1-' || path || '-' || strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS u1, {_DRAW.format(seed="'2-' || path || '-' || strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS u2 FROM c, range(200) t(path)),
z AS (SELECT *, CASE WHEN pv > 0 THEN pv * exp(sqrt(ln(1 + 0.25e0 * 0.25e0)) * {tails.normal_quantile_sql('u1')} - ln(1 + 0.25e0 * 0.25e0) / 2) ELSE pv END AS pv2,
 CASE WHEN rel > 0 THEN buy * exp(sqrt(ln(1 + rel * rel)) * {tails.normal_quantile_sql('u2')} - ln(1 + rel * rel) / 2) ELSE buy END AS buy2 FROM dr),
pa AS (SELECT day, path, sum(greatest(load - pv2, 0) * buy2 - greatest(pv2 - load, 0) * sell) AS cost, sum(load) AS kwh, sum(least(pv2, load)) AS own, sum(greatest(pv2 - load, 0)) AS over FROM z GROUP BY 1, 2), k AS (SELECT *, cost / kwh AS per FROM pa),
v AS (SELECT day, quantile_cont(per, 0.95) AS v, quantile_cont(cost, 0.95) AS cut FROM k GROUP BY 1)
"""
)


@query(
    "household_cvar",
    _PATHS + "SELECT k.day, count(*) AS paths, round(avg(per), 6) AS mean, round(any_value(v), 6) AS value_at_risk, round(avg(per) FILTER (per >= v), 6) AS cvar, round(avg(cost), 5) AS total, round(avg(cost) FILTER (cost >= cut), 5) AS total_cvar, round(avg(own), 5) AS self_consumed, round(avg(over), 5) AS exported FROM k JOIN v ON v.day = k.day GROUP BY k.day",
)
def household_cvar(spark, sf_dir):
    """Cost per kWh over 200 drawn paths of panels and prices of every day: prices spread with the days since their forecast, made anew every eight days, panels by 25 %."""
    rows = house(spark, sf_dir)
    first = rows.agg(F.min("day").alias("d0"))
    ahead = rows.crossJoin(F.broadcast(first)).withColumn("lead", F.pmod(F.date_diff("day", "d0"), F.lit(8)))
    rel = verify.prior_error(F.col("lead"))
    key = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    paths = panels.spread_paths(ahead.withColumn("key", key), ["key"], "pv", F.lit(0.25), 200, 1, "pv2")
    sigma = F.sqrt(F.ln(1 + rel * rel))
    paths = paths.withColumn("buy", panels.spread(F.col("buy"), sigma, F.concat_ws("-", F.lit(2), "path", "key"), below=True)).withColumn("pv", F.col("pv2"))
    out = panels.cost_distribution(paths, ["day"])
    return out.select("day", "paths", *[r(c).alias(c) for c in ("mean", "value_at_risk", "cvar")], *[r(c, 5).alias(c) for c in ("total", "total_cvar", "self_consumed", "exported")])


@query(
    "price_error_prior",
    ", l AS (SELECT ts, date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM hourly), CAST(ts AS DATE)) % 10 AS lead FROM hourly) SELECT ts, CAST(lead AS INTEGER) AS lead, [0.0, 0.0, 0.10, 0.15, 0.20, 0.25, 0.30][least(lead, 6) + 1]::DOUBLE AS error FROM l",
)
def price_error_prior(spark, sf_dir):
    """The relative price error to start from at each hour, by the days since a forecast made every ten days."""
    h = hourly(spark, sf_dir)
    rows = h.crossJoin(F.broadcast(h.agg(F.to_date(F.min("ts")).alias("d0")))).withColumn("lead", F.pmod(F.date_diff(F.to_date("ts"), "d0"), F.lit(10)))  # one row is broadcast
    return rows.select("ts", "lead", verify.prior_error(F.col("lead")).alias("error"))


_NOW = _HOUSE + ", g AS (SELECT *, hour - 11 AS ahead, pv * (0.5 + abs(sin(hour * 3 + dayofyear(day)))) AS measured FROM house), x AS (SELECT *, CASE WHEN pv >= 0.05 AND measured >= 0 THEN greatest(least(measured / pv, 3), 0.15) END AS k FROM g)\n"


@query(
    "panel_nowcast",
    _NOW + ", i AS (SELECT day, max(k) FILTER (hour = 11) AS k FROM x GROUP BY 1) SELECT x.day, CAST(x.hour AS BIGINT) AS hour, round(x.k, 6) AS index, round(CASE WHEN i.k IS NULL OR abs(i.k - 1) < 1e-9 OR ahead <= 0 THEN pv ELSE greatest(pv * i.k, 0) END, 6) AS yield FROM x JOIN i ON i.day = x.day",
)
def panel_nowcast(spark, sf_dir):
    """The clear-sky index of each hour, and the day's forecast scaled by that of 11 o'clock."""
    rows = _nowcast_rows(spark, sf_dir)
    at = rows.groupBy("day").agg(F.max(F.when(F.col("hour") == 11, F.col("k"))).alias("noon"))
    return rows.join(at, "day").select("day", F.col("hour").cast("long").alias("hour"), r("k").alias("index"), r(panels.nowcast(F.col("pv"), F.col("noon"), F.col("hour") - 11)).alias("yield"))


def _nowcast_rows(spark, sf_dir):
    measured = F.col("pv") * (0.5 + F.abs(F.sin(F.col("hour") * 3 + F.dayofyear("day"))))
    return house(spark, sf_dir).withColumn("measured", measured).withColumn("k", panels.clear_sky_index(F.col("measured"), F.col("pv")))


@query(
    "nowcast_confidence",
    _NOW + """, s AS (SELECT day, sum(pv) AS total, sum(CASE WHEN ahead <= 0 THEN pv ELSE 0 END) AS past, count(*) FILTER (hour = 11) > 0 AS live, max(k) FILTER (hour = 11) AS k FROM x GROUP BY 1), f AS (SELECT *, CASE WHEN total > 1e-9 THEN least(past / total, 1) ELSE 0 END AS share FROM s)
SELECT day, round(share, 6) AS share, CASE WHEN NOT live THEN 'low' WHEN share >= 0.6 THEN 'high' WHEN share >= 0.2 THEN 'medium' ELSE 'low' END AS confidence, coalesce(abs(k - 1) >= 0.2, FALSE) AS due FROM f""",
)
def nowcast_confidence(spark, sf_dir):
    """How much of the day lies behind at 11 o'clock, what that is worth, and whether to refresh."""
    rows = _nowcast_rows(spark, sf_dir).withColumn("ahead", F.col("hour") - 11)
    share = panels.realised_share(rows, ["day"], "pv", "ahead")
    at = rows.groupBy("day").agg((F.count_if(F.col("hour") == 11) > 0).alias("live"), F.max(F.when(F.col("hour") == 11, F.col("k"))).alias("k"))
    due = panels.refresh_due(F.col("k"), F.lit(None).cast("double"), F.lit(3600.0), 0.2, 900.0)
    return share.join(at, "day").select("day", r("share").alias("share"), panels.confidence(F.col("share"), F.col("live")).alias("confidence"), due.alias("due"))


@query(
    "index_smoothed",
    _NOW + """, n AS (SELECT day, ts, k, row_number() OVER (PARTITION BY day ORDER BY ts) AS n FROM x),
s AS (WITH RECURSIVE s AS (SELECT day, ts, n, k AS v FROM n WHERE n = 1 UNION ALL SELECT n.day, n.ts, n.n, CASE WHEN n.k IS NULL THEN s.v WHEN s.v IS NULL THEN n.k ELSE 0.7 * s.v + 0.3 * n.k END FROM s JOIN n ON n.day = s.day AND n.n = s.n + 1) SELECT * FROM s)
SELECT day, ts, round(v, 6) AS smooth FROM s""",
)
def index_smoothed(spark, sf_dir):
    """The index as an exponential mean over each day; nights keep the last one."""
    return online.smoothed(_nowcast_rows(spark, sf_dir), ["day"], "k", 0.3).select("day", "ts", r("smooth").alias("smooth"))


@query(
    "panel_gate",
    _HOUSE + "SELECT ts, round(CASE WHEN hour % 6 = 5 THEN pv WHEN pv * 400 <= 5 THEN 0 ELSE 0.9 * pv + 0.1 END, 6) AS yield FROM house",
)
def panel_gate(spark, sf_dir):
    """An outside forecast, 0 in the dark, and the own one where it is missing."""
    outside = F.when(F.col("hour") % 6 != 5, 0.9 * F.col("pv") + 0.1)
    return house(spark, sf_dir).select("ts", r(panels.gated(outside, F.col("pv"), F.col("pv") * 400)).alias("yield"))


@query(
    "block_bootstrap",
    """, f AS (SELECT day FROM whole GROUP BY 1), pl AS (SELECT DISTINCT f.day AS fr, ((dayofyear(f.day) - 1) % 365 + o + 365) % 365 AS place FROM f, (SELECT unnest(generate_series(-7, 7)) AS o)), pool AS (SELECT place, list(fr ORDER BY fr) AS pool FROM pl GROUP BY 1),
w AS (SELECT f.day, pool, path FROM f JOIN pool ON place = (dayofyear(f.day) - 1) % 365, range(20) t(path)),
d AS (SELECT day, path, pool[CAST(floor("""
    + _DRAW.format(seed="'42-' || strftime(day, '%Y-%m-%d') || '-' || path")
    + """ * len(pool)) AS BIGINT) + 1] AS fr FROM w), v AS (SELECT d.day, h.hour, path, h.p FROM d JOIN whole h ON h.day = d.fr)
SELECT day, CAST(hour AS BIGINT) AS hour, round(quantile_cont(p, 0.05), 6) AS p05, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.95), 6) AS p95 FROM v GROUP BY 1, 2""",
)
def block_bootstrap(spark, sf_dir):
    """Bands of 20 paths of whole days drawn from days of about the same season."""
    from gridloom.operators import curves

    rows = curves.complete_days(days(spark, sf_dir), ["day"])
    paths = panels.block_paths(rows.select("day", "hour"), rows.select("day", "hour", "p"), "p", 20)
    q = F.percentile("p", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return paths.groupBy("day", "hour").agg(q.alias("q")).select("day", F.col("hour").cast("long").alias("hour"), *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("p05", "p50", "p95"))])
