"""Weather to power columns: air, wind, sun, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.calendar import year_fraction

SOLAR_CONSTANT = 1367.0
# Monthly Linke turbidity, January first.
LINKE_TURBIDITY = [2.4, 2.5, 2.7, 2.9, 3.1, 3.3, 3.5, 3.4, 3.0, 2.7, 2.5, 2.4]


def air_density(celsius: Column, pressure: float = 101_325.0, gas: float = 287.05) -> Column:
    """Of dry air in kg/m3; null for a null."""
    return F.lit(pressure) / (F.lit(gas) * (celsius + 273.15))


def turbine_share(wind: Column, middle: float = 7.5, steep: float = 1.5) -> Column:
    """Share of rated power by a logistic curve over wind speed."""
    return 1 / (1 + F.exp(-(wind - middle) / steep))


def wind_power(wind: Column, celsius: Column, reference: float = 1.225) -> Column:
    """Turbine share times relative air density."""
    return turbine_share(wind) * air_density(celsius) / reference


def wind_cubed(wind: Column, celsius: Column) -> Column:
    """What drives a turbine: air density times the cube of the wind; null where either is."""
    return air_density(celsius) * F.pow(wind, 3)


def effective_irradiance(ghi: Column, celsius: Column, loss: float = 0.004, heating: float = 0.03) -> Column:
    """Irradiance less what cells lose that are hotter than 25 degrees."""
    return ghi * (1 - loss * F.greatest(celsius + heating * ghi - 25, F.lit(0.0)))


def _angle(ts: Column) -> Column:
    return 2 * F.pi() * year_fraction(ts)


def zenith_cosine(ts: Column, latitude: float | Column, longitude: float | Column) -> Column:
    """Cosine of the sun's zenith angle after Spencer (1971); 0 below the horizon."""
    a = _angle(ts)
    declination = 0.006918 - 0.399912 * F.cos(a) + 0.070257 * F.sin(a) - 0.006758 * F.cos(2 * a) + 0.000907 * F.sin(2 * a) - 0.002697 * F.cos(3 * a) + 0.00148 * F.sin(3 * a)
    minutes = 229.18 * (0.000075 + 0.001868 * F.cos(a) - 0.032077 * F.sin(a) - 0.014615 * F.cos(2 * a) - 0.040849 * F.sin(2 * a))
    hours = (F.unix_timestamp(ts) - F.unix_timestamp(F.date_trunc("day", ts))) / 3600 + longitude / 15 + minutes / 60
    lat = F.radians(F.lit(latitude) if isinstance(latitude, float) else latitude)
    cosine = F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(F.radians(15 * (hours - 12)))
    return F.greatest(cosine, F.lit(0.0))


def extraterrestrial(ts: Column) -> Column:
    """Irradiance above the air, with the orbit's eccentricity."""
    a = _angle(ts)
    return SOLAR_CONSTANT * (1.00011 + 0.034221 * F.cos(a) + 0.00128 * F.sin(a) + 0.000719 * F.cos(2 * a) + 0.000077 * F.sin(2 * a))


def haurwitz(cosine: Column) -> Column:
    """Clear-sky irradiance after Haurwitz (1945)."""
    return F.when(cosine > 0, 1098 * cosine * F.exp(-0.057 / cosine)).otherwise(F.lit(0.0))


def ineichen(cosine: Column, top: Column, turbidity: Column, altitude: float = 0.0) -> Column:
    """Clear-sky irradiance after Ineichen and Perez (2002), with the airmass of Kasten and Young."""
    airmass = 1 / (cosine + 0.50572 * F.pow(96.07995 - F.degrees(F.acos(cosine)), F.lit(-1.6364)))
    low, high = F.exp(F.lit(-altitude / 8000)), F.exp(F.lit(-altitude / 1250))
    haze = F.exp(-(3.92e-5 * altitude + 0.0387) * airmass * (low + high * (turbidity - 1)))
    clear = (5.09e-5 * altitude + 0.868) * top * cosine * haze * F.exp(0.01 * F.pow(airmass, F.lit(1.8)))
    return F.when(cosine > 0, F.greatest(clear, F.lit(0.0))).otherwise(F.lit(0.0))


def monthly_turbidity(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LINKE_TURBIDITY]), F.month(ts))


def kasten_czeplak(cloud_percent: Column, a: float = 0.75, b: float = 3.4) -> Column:
    """What clouds leave of clear-sky irradiance."""
    return 1 - a * F.pow(cloud_percent / 100, F.lit(b))


def cloud_modulator(cloud_percent: Column, form: str = "kasten_czeplak", start: float = 1.0, slope: float = 0.75, power: float = 3.4, floor: float = 0.0) -> Column:
    """What clouds leave of clear sky: by Kasten and Czeplak, in a line from 1, or in a line that ends at a floor."""
    share = cloud_percent / 100
    if form == "kasten_czeplak":
        return kasten_czeplak(cloud_percent, slope, power)
    if form == "linear":
        return 1 - slope * share
    if form == "affine_floor":
        return F.greatest(start - slope * share, F.lit(floor))
    raise ValueError(f"no such form: {form}")


def solar_mw(clear: Column, left: Column, base: float, gain: float) -> Column:
    """Solar power from clear-sky irradiance and what clouds leave of it; not below zero."""
    return F.greatest(base + gain * clear * left, F.lit(0.0))


def site_irradiance(hours: DataFrame, sites: DataFrame) -> DataFrame:
    """ts, ghi: clear-sky irradiance (Haurwitz) of the sites (lat, lon, weight: a row a site), weighted. Null hours have null irradiance; without a site there is no row."""
    each = hours.select("ts").crossJoin(sites)
    ghi = haurwitz(zenith_cosine(F.col("ts"), F.col("lat"), F.col("lon")))
    return each.groupBy("ts").agg((F.sum(F.col("weight") * ghi) / F.sum("weight")).alias("ghi"))


# The loss per squared degree from 45, and the least shares for tilt and azimuth.
TILT_LOSS, LEAST_TILT, MOST_TILT, LEAST_AZIMUTH = 0.0006, 0.6, 1.05, 0.4


def tilted_kwh(irradiance: Column, kwp: float, tilt: Column, azimuth: Column, efficiency: float = 0.85) -> Column:
    """Hourly yield of panels, corrected for tilt and azimuth, within 0 and what they can give."""
    tilted = F.greatest(F.least(1 - TILT_LOSS * F.pow(tilt - 45, F.lit(2)), F.lit(MOST_TILT)), F.lit(LEAST_TILT))
    off = F.abs(F.pmod(azimuth, F.lit(360.0)) - 180)
    turned = F.greatest(F.cos(F.radians(off) / 2), F.lit(LEAST_AZIMUTH))
    return F.least(F.greatest(irradiance / 1000 * kwp * efficiency * tilted * turned, F.lit(0.0)), F.lit(kwp * efficiency))


def panel_kwh(irradiance: Column, kwp: float, tilt: float = 45.0, azimuth: float = 180.0, efficiency: float = 0.85) -> Column:
    """The same for panels of one tilt and azimuth."""
    return tilted_kwh(irradiance, kwp, F.lit(float(tilt)), F.lit(float(azimuth)), efficiency)


def soft_floor(price: Column, floor: float = -5.0) -> Column:
    """The price above a floor, by softplus: it nears the floor and never goes below."""
    over = price - floor
    return floor + F.greatest(over, F.lit(0.0)) + F.log1p(F.exp(-F.abs(over)))
