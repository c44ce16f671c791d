"""Panels and households: nowcasts, loads, cost over drawn paths.

Draws are hashes of a seed, a path and an hour, so that every run and every partition draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.names import fresh_name
from gridloom.operators.tails import normal_quantile, uniform

# Bounds of the clear-sky index, and the least forecast in kWh that it is told of.
LEAST_INDEX, MOST_INDEX, LEAST_FORECAST = 0.15, 3.0, 0.05


def clear_sky_index(measured: Column, forecast: Column) -> Column:
    """Measured over forecast yield, within bounds; null at night and without a measurement."""
    usable = (forecast >= LEAST_FORECAST) & (measured >= 0)
    return F.when(usable, F.greatest(F.least(measured / forecast, F.lit(MOST_INDEX)), F.lit(LEAST_INDEX)))


def nowcast(forecast: Column, index: Column, hours_from_now: Column) -> Column:
    """The forecast, scaled by the index from now on; without an index as it is."""
    scaled = F.greatest(forecast * index, F.lit(0.0))
    return F.when(index.isNull() | (F.abs(index - 1) < 1e-9) | (hours_from_now <= 0), forecast).otherwise(scaled)


def realised_share(rows: DataFrame, keys: list[str], forecast: str, hours_from_now: str) -> DataFrame:
    """keys, share: how much of a day's forecast yield lies behind; 0 for a day without any."""
    up = F.greatest(F.col(forecast), F.lit(0.0))
    total, past = F.sum(up), F.sum(F.when(F.col(hours_from_now) <= 0, up).otherwise(0.0))
    return rows.groupBy(*keys).agg(F.when(total > 1e-9, F.greatest(F.least(past / total, F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0)).alias("share"))


def confidence(share: Column, live: Column) -> Column:
    """low, medium or high, by how much of the day's yield has been measured; low where the meter isn't live. A null share counts as little."""
    return F.when(~live, "low").when(share >= 0.6, "high").when(share >= 0.2, "medium").otherwise("low")


def refresh_due(index: Column, applied: Column, seconds: Column, delta: float, least_gap: float) -> Column:
    """Whether the index has moved far enough from the applied one (1 without), and long enough after the last refresh."""
    early = F.coalesce(seconds < least_gap, F.lit(False))
    return F.coalesce(~early & (F.abs(index - F.coalesce(applied, F.lit(1.0))) >= delta), F.lit(False))


def gated(external: Column, internal: Column, irradiance: Column, dark: float = 5.0) -> Column:
    """An outside forecast, 0 in the dark; where there is none, the own one."""
    return F.when(external.isNull(), internal).when(irradiance <= dark, F.lit(0.0)).otherwise(external)


def spread_paths(rows: DataFrame, keys: list[str], value: str, relative: Column, paths: int, seed: int, out: str) -> DataFrame:
    """rows, each ``paths`` times, with path and a log-normal multiple of value of mean 1 and the given relative spread.

    Values that aren't above 0, and rows without spread, stay as they are. keys name a row.
    """
    sigma = F.sqrt(F.ln(1 + relative * relative))
    each = rows.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    return each.withColumn(out, spread(F.col(value), sigma, F.concat_ws("-", F.lit(seed), "path", *keys)))


def spread(value: Column, sigma: Column, seed: Column, below: bool = False) -> Column:
    """value times a log-normal draw of mean 1; as it is without spread. below: values below 0 are drawn too (prices), else they stay."""
    drawn = value * F.exp(sigma * normal_quantile(uniform(seed, 0)) - sigma * sigma / 2)
    return F.when((sigma > 0) if below else (value > 0) & (sigma > 0), drawn).otherwise(value)


def cost_distribution(rows: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """keys, paths, mean, value_at_risk, cvar (per kWh), total, total_cvar, self_consumed, exported (means over paths).

    rows: keys, path, buy, sell, pv, load of each hour and path. Paths without load take no part in what is per kWh. Two aggregates: by
    path, then by key; the quantiles hold a key's paths.
    """
    own, over = F.least("pv", "load"), F.greatest(F.col("pv") - F.col("load"), F.lit(0.0))
    cost = F.greatest(F.col("load") - F.col("pv"), F.lit(0.0)) * F.col("buy") - over * F.col("sell")
    by_path = rows.groupBy(*keys, "path").agg(F.sum(cost).alias("cost"), F.sum("load").alias("kwh"), F.sum(own).alias("own"), F.sum(over).alias("over"))
    by_path = by_path.withColumn("per", F.when(F.col("kwh") > 0, F.try_divide(F.col("cost"), F.col("kwh"))))
    cuts = by_path.groupBy(*keys).agg(F.percentile("per", 1 - alpha).alias("value_at_risk"), F.percentile("cost", 1 - alpha).alias("cut"))
    joined = by_path.join(cuts, keys)  # a row a key
    return joined.groupBy(*keys).agg(
        F.count("*").alias("paths"), F.avg("per").alias("mean"), F.first("value_at_risk").alias("value_at_risk"), F.avg(F.when(F.col("per") >= F.col("value_at_risk"), F.col("per"))).alias("cvar"),
        F.avg("cost").alias("total"), F.avg(F.when(F.col("cost") >= F.col("cut"), F.col("cost"))).alias("total_cvar"), F.avg("own").alias("self_consumed"), F.avg("over").alias("exported"),
    )


def block_paths(hours: DataFrame, history: DataFrame, value: str, paths: int, days: int = 7, seed: int = 42) -> DataFrame:
    """day, hour, path, <value>: for each day of hours (day, hour), paths of whole days drawn from history (day, hour, value).

    A path's day is drawn among history's days of 24 hours whose day of the year lies within ``days`` around the year. Days are drawn, then
    joined to their hours, so that what is exchanged is a row a day and path. A day without candidates has no path.
    """
    whole = history.filter(F.col(value).isNotNull()).groupBy("day").agg(F.count("*").alias("n")).filter("n = 24").select(F.col("day").alias("from"))
    around = F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("off")
    place = lambda d: F.pmod(F.dayofyear(d) - 1, F.lit(365))
    near = whole.select("from", around).select("from", F.pmod(place(F.col("from")) + F.col("off"), F.lit(365)).alias("place")).distinct()
    pools = near.groupBy("place").agg(F.array_sort(F.collect_list("from")).alias("pool"))  # days of a fortnight, over the years
    wanted = hours.select("day").distinct().withColumn("place", place(F.col("day"))).join(pools, "place")
    each = wanted.select("day", "pool", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("path"))
    at = F.floor(uniform(F.concat_ws("-", F.lit(seed), F.col("day").cast("string"), "path"), 0) * F.size("pool")).cast("int")
    drawn = each.select("day", "path", F.get("pool", at).alias("from"))
    return drawn.join(history.select(F.col("day").alias("from"), "hour", value), "from").join(hours.select("day", "hour"), ["day", "hour"], "left_semi").select("day", "hour", "path", value)


def synthetic_shape(spark) -> DataFrame:
    """weekday, hour, share: a load shape of morning and evening peaks, higher at weekends, of mean 1."""
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    raw = (0.6 + 0.5 * F.exp(-F.pow((F.col("hour") - 8) / 2.5, 2)) + 0.9 * F.exp(-F.pow((F.col("hour") - 19) / 3.0, 2))) * F.when(F.col("weekday") >= 5, 1.1).otherwise(1.0)
    return grid.withColumn("raw", raw).withColumn("share", F.col("raw") / F.avg("raw").over(Window.partitionBy())).drop("raw")  # 168 rows


def load(hours: DataFrame, shape: DataFrame, factors: list[float | None], annual_kwh: float) -> DataFrame:
    """hours (ts) with ``load``: the mean hour times the shape by local weekday and hour times the month's factor (1 where null or missing).

    shape has 168 rows at most, so it may go to every task; places that it lacks count as 1.
    """
    month, at, weekday, hour = *fresh_name(hours, "month", "at"), "weekday", "hour"
    marked = hours.withColumn(at, calendar.local(F.col("ts"))).withColumns({weekday: F.weekday(at), hour: F.hour(at), month: F.month(at)})
    factor = F.coalesce(F.get(F.array(*[F.lit(f).cast("double") for f in factors]), F.col(month) - 1), F.lit(1.0))
    joined = marked.join(F.broadcast(shape.select(weekday, hour, "share")), [weekday, hour], "left")
    return joined.withColumn("load", annual_kwh / 8760 * F.coalesce("share", F.lit(1.0)) * factor).drop(weekday, hour, at, month, "share")


def base_load(daily_kwh: float, month: Column, factors: list[float]) -> Column:
    """The mean hour of a day's energy times the month's factor, 0.05 kWh at least; also where the month is null."""
    return F.greatest(F.lit(0.05), daily_kwh / 24 * F.element_at(F.array(*[F.lit(f) for f in factors]), month))


def strategy(load: Column, mean: Column, kind: str) -> Column:
    """A load as it is, flat at its mean, or turned around its mean (not below 0)."""
    return {"shaped": load, "flat": mean, "anti": F.greatest(2 * mean - load, F.lit(0.0))}[kind]


def normal_density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
