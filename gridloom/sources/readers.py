"""Readers of files that meters, agencies and models leave: CSV exports, JSON reports, JSON artefacts.

Each gives a DataFrame; what isn't readable is left out as the docstrings say, so that one bad line stops no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONES = ["no1", "no2", "no3", "no4", "no5"]


def meter_csv(spark: SparkSession, path: str, estimated: bool = True) -> DataFrame:
    """ts, kwh of a meter's export: semicolons, decimal commas, a header; quarters of an hour are added up to hours.

    The time is the column before the last two that reads as one, the amount the last but one, the quality the last (OK or EST). Lines without a time or an
    amount are left out; without ``estimated`` only those of quality OK count. Times without a zone are UTC.
    """
    raw = spark.read.option("sep", ";").option("header", "true").option("encoding", "UTF-8").csv(path)
    names = [f"c{i}" for i in range(len(raw.columns))]
    rows = raw.toDF(*names)
    amount = F.expr(f"try_cast(replace(trim({names[-2]}), ',', '.') as double)")
    at = F.coalesce(*[F.try_to_timestamp(F.col(n)) for n in names[: len(names) - 2]])
    if not estimated:
        rows = rows.filter(F.trim(names[-1]) == "OK")
    return rows.select(F.date_trunc("hour", at).alias("ts"), amount.alias("kwh")).na.drop().groupBy("ts").agg(F.sum("kwh").alias("kwh"))


def reservoir_weeks(spark: SparkSession, path: str) -> DataFrame:
    """year, week, total, zones (a map) of reservoir reports {"currentYear": [{"year", "week", "total", "no1", ..}]}, a file each.

    Entries without a year or week are left out; a missing total counts as 0, a missing zone isn't in the map.
    """
    entry = "struct<year:string,week:string,total:double," + ",".join(f"{z}:double" for z in ZONES) + ">"
    raw = spark.read.option("wholetext", "true").text(path)
    each = raw.select(F.explode(F.from_json("value", f"currentYear array<{entry}>")["currentYear"]).alias("e"))
    pairs = F.filter(F.array(*[F.struct(F.lit(z).alias("key"), F.col(f"e.{z}").alias("value")) for z in ZONES]), lambda p: p["value"].isNotNull())
    number = lambda c: F.expr(f"try_cast(e.{c} as int)").alias(c)
    return each.select(number("year"), number("week"), F.coalesce("e.total", F.lit(0.0)).alias("total"), F.map_from_entries(pairs).alias("zones")).filter("year is not null and week is not null")


def week_offsets(weeks: DataFrame) -> DataFrame:
    """weeks with ``offset``: the total less the mean of that week over the years."""
    means = weeks.groupBy("week").agg(F.avg("total").alias("mean"))
    return weeks.join(means, "week").withColumn("offset", F.col("total") - F.col("mean")).drop("mean")


def coefficients(spark: SparkSession, path: str) -> DataFrame:
    """feature, coef of a model file {"intercept", "features": [{"name", "coef"}]}; the intercept is a row of its own.

    A file that isn't such a model, or none, gives the null model: an intercept of 0.
    """
    schema = "intercept double, features array<struct<name:string,coef:double>>"
    try:
        raw = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", schema).alias("m")).filter("m.features is not null")
        model = raw.select(F.explode(F.concat(F.array(F.struct(F.lit("intercept").alias("name"), F.coalesce("m.intercept", F.lit(0.0)).alias("coef"))), "m.features")).alias("f")).select(F.col("f.name").alias("feature"), F.coalesce("f.coef", F.lit(0.0)).alias("coef"))
        if model.limit(1).count():
            return model
    except Exception as error:  # a missing file is told only when the plan is made
        if "PATH_NOT_FOUND" not in str(error):
            raise
    return spark.createDataFrame([("intercept", 0.0)], "feature string, coef double")


def seasonal_parts(spark: SparkSession, path: str) -> DataFrame:
    """name, part, bin, mean of an artefact {"components": {name: {"P_hour": [..], "P_day": [..], "P_week": [..]}}}."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "components map<string,map<string,array<double>>>")["components"].alias("c"))
    named = raw.select(F.explode("c").alias("name", "parts")).select("name", F.explode("parts").alias("part", "means"))
    return named.select("name", F.lower(F.regexp_replace("part", "^P_", "")).alias("part"), F.posexplode("means").alias("bin", "mean"))


def coerced(text: Column) -> Column:
    """A time told as ISO text (a space or T, with or without a zone) or as UNIX seconds; null where it is neither. Zones are kept to."""
    seconds = text.try_cast("double")
    return F.when(seconds > 1e9, F.timestamp_seconds(seconds)).when(seconds.isNotNull(), F.lit(None).cast("timestamp")).otherwise(F.try_to_timestamp(text))


def counter_daily(rows: DataFrame, keys: list[str], value: str, days: int = 14) -> DataFrame:
    """keys, daily: what a running counter rose a day over the last ``days`` days; null where it didn't rise."""
    last = rows.groupBy(*keys).agg(F.max("ts").alias("end"), F.max_by(value, "ts").alias("now"))
    recent = rows.filter(F.col(value).isNotNull()).join(last, keys).filter(F.col("ts") >= F.col("end") - F.expr(f"interval {days} days"))
    rise = F.first("now") - F.min_by(value, "ts")
    return recent.groupBy(*keys).agg(F.when(rise > 0, rise / days).alias("daily"))


def power_daily(rows: DataFrame, keys: list[str], value: str, days: int = 28, watts: bool = True) -> DataFrame:
    """keys, daily: energy a day by the mean of daily mean powers over the last ``days`` days."""
    end = rows.groupBy(*keys).agg(F.max("ts").alias("end"))
    recent = rows.join(end, keys).filter(F.col("ts") >= F.col("end") - F.expr(f"interval {days} days"))
    by_day = recent.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.avg(value).alias("mean"))
    return by_day.groupBy(*keys).agg((F.avg("mean") * 24 / (1000 if watts else 1)).alias("daily"))


def site_means(rows: DataFrame, sites: DataFrame, site: str, values: dict[str, str]) -> DataFrame:
    """ts and the mean of each value over the sites that have one at that time, weighted by the site's weight for it.

    values: from value to the weight's column in sites (a row a site).
    """
    joined = rows.join(sites, site)
    mean = lambda v, w: F.try_divide(F.sum(F.when(F.col(v).isNotNull(), F.col(v) * F.col(w))), F.sum(F.when(F.col(v).isNotNull(), F.col(w))))
    return joined.groupBy("ts").agg(*[mean(v, w).alias(v) for v, w in values.items()])
