"""The registry of queries, and the series that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The SQL of ``hourly`` and ``zonal``, put before each query's own.
SERIES = """WITH hourly AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS p FROM events GROUP BY 1),
zonal AS (SELECT event_type AS zone, date_trunc('hour', ts) AS ts, avg(value) AS p FROM events GROUP BY 1, 2),
days AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, ts, p FROM hourly),
whole AS (SELECT * FROM days WHERE day IN (SELECT day FROM days GROUP BY day HAVING count(*) = 24)),
pairs AS (SELECT a.ts, a.p AS actual, b.p AS pred FROM hourly a JOIN hourly b ON b.ts = a.ts - INTERVAL 24 HOUR)
"""

#: The local time of ts in SQL, the steps from years (y) to their holidays (hol), and the holidays of 2023 to 2025.
LOCAL = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Helsinki')"
HOLIDAY_STEPS = """a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
n AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM l),
e AS (SELECT y, make_date(y, CAST(n // 31 AS INTEGER), CAST(n % 31 + 1 AS INTEGER)) AS easter FROM n),
f AS (SELECT y, d.d AS day FROM e, generate_series(make_date(y, 6, 19)::TIMESTAMP, make_date(y, 6, 25)::TIMESTAMP, INTERVAL 1 DAY) AS d(d) WHERE isodow(d.d) = 5),
s AS (SELECT y, d.d AS day FROM e, generate_series(make_date(y, 10, 31)::TIMESTAMP, make_date(y, 11, 6)::TIMESTAMP, INTERVAL 1 DAY) AS d(d) WHERE isodow(d.d) = 6),
hol AS (SELECT make_date(y, m.m, m.d) AS day FROM y, (VALUES (1, 1), (1, 6), (5, 1), (12, 6), (12, 24), (12, 25), (12, 26)) AS m(m, d)
 UNION SELECT CAST(easter + o.o AS DATE) FROM e, (VALUES (-2), (0), (1), (39), (49)) AS o(o)
 UNION SELECT CAST(day AS DATE) FROM f UNION SELECT CAST(day AS DATE) + 1 FROM f UNION SELECT CAST(day AS DATE) FROM s)
"""
HOLIDAYS = ", y AS (SELECT CAST(unnest([2023, 2024, 2025]) AS INTEGER) AS y), " + HOLIDAY_STEPS


def query(name: str, sql: str | None = None):
    """Registers a query; sql goes on after SERIES, unless it starts with its own WITH or SELECT of tables."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.lstrip().startswith("--") else SERIES + sql
        return function

    return add


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, p: the mean value of each hour that has events."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "value")
    return events.groupBy("ts").agg(F.avg("value").alias("p"))


def zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, ts, p: the same for each event type."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "value")
    return events.groupBy("zone", "ts").agg(F.avg("value").alias("p"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly with day and hour."""
    return hourly(spark, sf_dir).select(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "ts", "p")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, actual, pred: each hour with the price a day before as its forecast."""
    from gridloom.operators.align import time_lag

    return time_lag(hourly(spark, sf_dir), [], "p", 24, "pred").filter("pred is not null").select("ts", F.col("p").alias("actual"), "pred")


def r(column, places: int = 6):
    """Rounded, without a negative zero."""
    return F.round(column, places) + 0.0
