"""Forecasts in layers: seasonal parts, a linear model on deviations, a decaying residual, a soft floor, bias, bands.

A model is plain values: coefficients by feature, a decay, the tails of what is left, and a table of seasonal parts. All layers are columns of one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import physics
from gridloom.operators import fits, smooth
from gridloom.operators.tails import normal_quantile

#: Features of which more may not raise a price.
NOT_POSITIVE = ("wind_share", "sun_effective")
LAG_HOURS = 168


def signed(coefficients: dict[str, float]) -> dict[str, float]:
    """Coefficients, those of NOT_POSITIVE held at 0 where they are above."""
    return {f: min(c, 0.0) if f in NOT_POSITIVE else c for f, c in coefficients.items()}


def bins(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "day": F.weekday(ts)}


def deviations(rows: DataFrame, value: str, parts: DataFrame | None, ts: str = "ts") -> DataFrame:
    """rows with the value less its seasonal parts (part, bin, mean) at a time; without parts, less its mean. Nulls become 0."""
    if parts is None:
        mean = rows.agg(F.avg(value).alias("mean"))
        return rows.crossJoin(F.broadcast(mean)).withColumn(value, F.coalesce(F.col(value) - F.col("mean"), F.lit(0.0))).drop("mean")
    told = smooth.seasonal_part(rows, [], parts, bins(F.col(ts)))
    return told.withColumn(value, F.coalesce(F.col(value) - F.col("seasonal"), F.lit(0.0))).drop("seasonal")


def design(rows: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """rows (ts, wind, sun, temp, price_lag, and what else is a feature) with wind_share, sun_effective, temp and price_lag as deviations.

    The lagged price deviates from the parts of the hour that it was seen in. parts: by feature.
    """
    out = rows.withColumn("wind_share", physics.wind_power(F.col("wind"), F.col("temp"))).withColumn("sun_effective", physics.effective_irradiance(F.col("sun"), F.col("temp")))
    out = out.withColumn("seen", F.col("ts") - F.expr(f"interval {LAG_HOURS} hours"))
    for name, at in (("wind_share", "ts"), ("sun_effective", "ts"), ("temp", "ts"), ("price_lag", "seen")):
        out = deviations(out, name, parts.get(name), at)
    return out.drop("seen")


def layered(rows: DataFrame, level: DataFrame, coefficients: dict[str, float], phi: float, last: float, floor: float = -5.0) -> DataFrame:
    """rows (the design's, with ``step`` from 1) with seasonal, linear, decay and ``mean``, the floored sum; a feature that isn't there counts as 0."""
    told = smooth.seasonal_part(rows, [], level, bins(F.col("ts")))
    known = {f: c for f, c in signed(coefficients).items() if f == "intercept" or f in rows.columns}
    told = told.withColumn("linear", fits.dot(known)).withColumn("decay", F.pow(F.lit(phi), F.col("step")) * last)
    return told.withColumn("mean", physics.soft_floor(F.col("seasonal") + F.col("linear") + F.col("decay"), floor))


def shock_quantile(u: Column, tails: dict[str, float]) -> Column:
    """The quantile of a normal body between -u0 and u0 with generalised Pareto tails: keys u0, mu, sigma, and xi, scale, share on the right and left
    (xi_r, scale_r, share_r, ..)."""
    u0, left, right = tails["u0"], tails["share_l"], tails["share_r"]

    def beyond(share: Column, side: str) -> Column:
        xi, scale = tails[f"xi_{side}"], tails[f"scale_{side}"]
        return -scale * F.ln(share) if abs(xi) < 1e-9 else scale / xi * (F.pow(share, F.lit(-xi)) - 1)

    body = F.greatest(F.least(tails["mu"] + tails["sigma"] * normal_quantile((u - left) / (1 - left - right)), F.lit(u0)), F.lit(-u0))
    return F.when(u < left, -u0 - beyond(u / left, "l")).when(u > 1 - right, u0 + beyond((1 - u) / right, "r")).otherwise(body)


def with_bands(rows: DataFrame, mean: str, tails: dict[str, float], levels: dict[str, float]) -> DataFrame:
    """rows with a column for each level: the mean and the shocks' quantile there. The shocks are the same for each hour, so no paths are made."""
    return rows.withColumns({name: F.col(mean) + shock_quantile(F.lit(u), tails) for name, u in levels.items()})


def filled_lag(rows: DataFrame, kind: str, value: str, last: str, mean: str, phi: float, lead: str) -> DataFrame:
    """rows with ``filled``: a neighbour's price that isn't known at a lead, as its mean (zero), its last value (persist), a decay from one to the other (ar1) or itself (oracle)."""
    ways = {"zero": F.col(mean), "persist": F.col(last), "ar1": F.col(mean) + F.pow(F.lit(phi), F.col(lead)) * (F.col(last) - F.col(mean)), "oracle": F.col(value)}
    return rows.withColumn("filled", ways[kind])
