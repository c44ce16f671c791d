"""Calendar columns: local time, bins, Finnish holidays, day length, Fourier terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Europe/Helsinki"
# Holidays by month and day, and by days from Easter Sunday.
FIXED_HOLIDAYS = [(1, 1), (1, 6), (5, 1), (12, 6), (12, 24), (12, 25), (12, 26)]
EASTER_OFFSETS = [-2, 0, 1, 39, 49]


def local(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time in a zone, of a UTC time."""
    return F.from_utc_timestamp(ts, zone)


def is_workday(ts: Column) -> Column:
    """Monday to Friday, whatever the holidays; null for a null."""
    return F.weekday(ts) < 5


def is_night_tariff(local_ts: Column) -> Column:
    """Night hours are those before 7 and from 22."""
    return (F.hour(local_ts) < 7) | (F.hour(local_ts) >= 22)


def easter_sunday(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by the anonymous computus."""
    div = lambda x, n: F.floor(x / n)
    golden, century, rest = year % 19, div(year, 100), year % 100
    epact = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * div(rest, 4) - epact - rest % 4) % 7
    late = div(golden + 11 * epact + 22 * weekday, 451)
    days = epact + weekday - 7 * late + 114
    return F.make_date(year.cast("int"), div(days, 31).cast("int"), (days % 31 + 1).cast("int"))


def holidays(years: DataFrame) -> DataFrame:
    """day, of each holiday in each row's ``year``."""
    year = F.col("year")
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    moving = [F.date_add(easter_sunday(year), d) for d in EASTER_OFFSETS]
    midsummer_eve = F.next_day(F.make_date(year, F.lit(6), F.lit(18)), "Fri")
    saints = F.next_day(F.make_date(year, F.lit(10), F.lit(30)), "Sat")
    return years.select(F.explode(F.array_distinct(F.array(*fixed, *moving, midsummer_eve, F.date_add(midsummer_eve, 1), saints))).alias("day"))


def holidays_between(spark: SparkSession, first: int, last: int) -> DataFrame:
    return holidays(spark.range(first, last + 1).select(F.col("id").cast("int").alias("year")))


def daylight_hours(day_of_year: Column, latitude: float = 62.0) -> Column:
    """Hours of daylight from the sun's declination; 0 in polar night, 24 in polar day."""
    declination = F.radians(F.lit(23.45)) * F.sin(2 * F.pi() * (day_of_year + 284) / 365.0)
    cosine = -F.tan(F.radians(F.lit(latitude))) * F.tan(declination)
    return 24 / F.pi() * F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def year_fraction(ts: Column) -> Column:
    """Time gone of the year of a UTC time, 0 to 1."""
    start = F.unix_timestamp(F.date_trunc("year", ts))
    following = F.unix_timestamp(F.date_trunc("year", ts) + F.expr("interval 1 year"))
    return (F.unix_timestamp(ts) - start) / (following - start)


def fourier(phase: Column, orders: int, prefix: str) -> list[Column]:
    """sin and cos of a phase (0 to 1) for each order."""
    return [f(2 * F.pi() * k * phase).alias(f"{prefix}_{n}{k}") for k in range(1, orders + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]


def ring_distance(a: Column, b: Column, size: int = 365) -> Column:
    """The shorter way between two days of the year."""
    return F.least(F.abs(a - b), size - F.abs(a - b))


def configured_holidays(years: DataFrame, rules: list[dict]) -> DataFrame:
    """day, kind of each rule in each row's ``year``. Rules: fixed (month, day); easter (offset in days); weekday (the first such weekday, as Mon to Sun, from
    month and day on). Another type is an error."""
    year, made = F.col("year"), []
    for rule in rules:
        if rule["type"] == "fixed":
            day = F.make_date(year, F.lit(rule["month"]), F.lit(rule["day"]))
        elif rule["type"] == "easter":
            day = F.date_add(easter_sunday(year), rule["offset"])
        elif rule["type"] == "weekday":
            day = F.next_day(F.date_sub(F.make_date(year, F.lit(rule["month"]), F.lit(rule["day"])), 1), rule["weekday"])
        else:
            raise ValueError(f"no such rule: {rule['type']}")
        made.append(F.struct(day.alias("day"), F.lit(rule["type"]).alias("kind")))
    return years.select(F.explode(F.array(*made)).alias("h")).select("h.*")
