"""Feature columns of price models: cycles, heating, scarcity, nuclear, net load, neighbours, and variance-stabilising transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import calendar

#: Nuclear capacity in MW that the nuclear share stands for.
NUCLEAR_MW = 4372.0


def bump(hour: Column, centre: float, width: float) -> Column:
    """A Gaussian bump over the hours of a day."""
    return F.exp(-0.5 * F.pow((hour - centre) / width, 2))


def over(x: Column, least: float = 0.0) -> Column:
    return F.greatest(x - least, F.lit(0.0))


def with_calendar(hours: DataFrame, holidays: DataFrame) -> DataFrame:
    """hours (ts) with local_hour, local_month, is_holiday and is_workday of the local calendar.

    holidays: day. The planner broadcasts it if it is small. Hours without a ts have nulls and no holiday.
    """
    at = calendar.local(F.col("ts"))
    marked = hours.withColumn("local_day", F.to_date(at)).join(holidays.select(F.col("day").alias("local_day"), F.lit(1.0).alias("is_holiday")).distinct(), "local_day", "left")
    holiday = F.coalesce("is_holiday", F.lit(0.0))
    return marked.withColumns(
        {"local_hour": F.hour(at), "local_month": F.month(at), "is_holiday": holiday, "is_workday": calendar.is_workday(F.col("local_day")).cast("double") * (1 - holiday)}
    )


def base_features(hours: DataFrame, holidays: DataFrame, heat_below: float = 17.0) -> DataFrame:
    """hours (ts, wind in m/s, temp in degrees) with the calendar's columns, the weather features and ``scarcity``.

    Null weather makes null features.
    """
    out = with_calendar(hours, holidays)
    hour, wind, cold = F.col("local_hour"), F.col("wind"), over(-F.col("temp"), -heat_below)
    am, pm = bump(hour, 9, 1.8), bump(hour, 19, 2.0)
    cycle = lambda f, x, n: f(2 * F.pi() * F.col(x) / n)
    return out.withColumns(
        {
            "hour_sin": cycle(F.sin, "local_hour", 24), "hour_cos": cycle(F.cos, "local_hour", 24), "month_sin": cycle(F.sin, "local_month", 12), "month_cos": cycle(F.cos, "local_month", 12),
            "hdd_sq": cold * cold,
            "wind_log_scarcity": F.log1p(over(-wind, -8.0)),
            "calm_x_morning": over(-wind, -6.0) * am * F.col("is_workday"),
            "calm_x_evening": over(-wind, -6.0) * pm * F.col("is_workday"),
            "scarcity": over(-wind, -5.0) * cold * F.greatest(am, pm),
        }
    )


def nuclear_features(rows: DataFrame) -> DataFrame:
    """rows (nuclear share of capacity, scarcity) with nuclear_deficit and its product with scarcity; a null share counts as 0."""
    deficit = over(1 - F.coalesce("nuclear", F.lit(0.0)))
    return rows.withColumns({"nuclear_deficit": deficit, "nuclear_x_scarcity": deficit * F.col("scarcity")})


def centred(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with <c>_centred for each column: its value less the mean of all rows, or of its group.

    The means are one small aggregate that goes back to the rows.
    """
    means = rows.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    joined = rows.join(means, by) if by else rows.crossJoin(F.broadcast(means))  # without groups it is one row
    return joined.withColumns({f"{c}_centred": F.col(c) - F.col(f"{c}_mean") for c in columns}).drop(*[f"{c}_mean" for c in columns])


def net_load_features(rows: DataFrame) -> DataFrame:
    """rows (consumption, wind_mw, solar_mw, nuclear, is_workday, scarcity) with net load in GW, squared about its mean, and products."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gw = (zero("consumption") - zero("wind_mw") - zero("solar_mw") - zero("nuclear") * NUCLEAR_MW) / 1000
    out = centred(rows.withColumn("net_load_gw", gw), ["net_load_gw"])
    out = out.withColumn("net_load_squared", F.pow("net_load_gw_centred", F.lit(2))).drop("net_load_gw_centred")
    return out.withColumns({"net_load_x_workday": F.col("net_load_gw") * F.col("is_workday"), "net_load_x_scarcity": F.col("net_load_gw") * F.col("scarcity")})


def stabiliser(rows: DataFrame, column: str) -> DataFrame:
    """One row: a, the median, and b, 1.4826 median absolute deviations (1 where there is no deviation)."""
    middle = rows.agg(F.percentile(column, F.lit(0.5)).alias("a"))
    off = rows.crossJoin(F.broadcast(middle)).groupBy("a").agg((1.4826 * F.percentile(F.abs(F.col(column) - F.col("a")), F.lit(0.5))).alias("b"))
    return off.select("a", F.when(F.col("b") > 0, F.col("b")).otherwise(F.lit(1.0)).alias("b"))


def stabilised(x: Column, kind: str, a: Column, b: Column) -> Column:
    """asinh of the distance from a in units of b, or log of x + 20."""
    return F.asinh((x - a) / b) if kind == "asinh" else F.ln(F.greatest(x + 20, F.lit(1e-6)))


def restored(y: Column, kind: str, a: Column, b: Column) -> Column:
    """The inverse of ``stabilised``."""
    return F.sinh(y) * b + a if kind == "asinh" else F.exp(y) - 20


def one_hot(place: Column, size: int, prefix: str, first: int = 1) -> list[Column]:
    """1 or 0 for each of the places from ``first`` on, so that the places before are the base."""
    return [(place == k).cast("double").alias(f"{prefix}{k}") for k in range(first, size)]
