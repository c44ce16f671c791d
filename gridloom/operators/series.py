"""Rolling, seasonal and fitted views of keyed series (keys, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name


def rolling(keys: list[str], before: int, after: int = 0):
    """A window of the rows around each row of a series."""
    return Window.partitionBy(*keys).orderBy("ts").rowsBetween(-before, after)


def rolling_hours(keys: list[str], hours: int):
    """A window of the hours up to each row, by time."""
    return Window.partitionBy(*keys).orderBy(F.unix_timestamp("ts")).rangeBetween(-hours * 3600 + 1, 0)


def over_hours(rows: DataFrame, keys: list[str], hours: int, made, chunk_hours: int | None = None) -> DataFrame:
    """rows with the columns that ``made(window)`` gives, over the last ``hours`` hours up to each row, by time.

    A key's rows are cut into stretches of ``chunk_hours`` (by default four times as long as the window), each with a copy of the window's length before it, so that a key's
    windows are shared by as many tasks as it has stretches and not done by one. Rows without a ts have their own stretch.
    """
    size = 3600 * (chunk_hours or 4 * hours)
    chunk, copied = fresh_name(rows, "chunk", "copied")
    second = F.unix_timestamp("ts")
    own = F.floor(second / size)
    # a row also serves the stretches that begin within the window's length behind it
    last = F.floor((second + hours * 3600 - 1) / size)
    dealt = rows.withColumn(chunk, F.explode(F.when(second.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(own, last)))).withColumn(copied, F.coalesce(F.col(chunk) > own, F.lit(False)))
    window = Window.partitionBy(*keys, chunk).orderBy(second).rangeBetween(-hours * 3600 + 1, 0)
    return dealt.withColumns(made(window)).filter(~F.col(copied)).drop(chunk, copied)


def seasonal(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """series with by_hour, by_weekday, by_week and residual: means by UTC bin, each taken of what the one before leaves.

    A window a part, so that the series is read once and dealt anew three times. Null values have null parts.
    """
    out = series.withColumn("residual", F.col(value))
    for name, place in {"by_hour": F.hour("ts"), "by_weekday": F.weekday("ts"), "by_week": F.weekofyear("ts")}.items():
        out = out.withColumn(name, F.avg("residual").over(Window.partitionBy(*keys, place))).withColumn("residual", F.col("residual") - F.col(name))
    return out


def circular_smooth(bins: DataFrame, keys: list[str], place: str, value: str, size: int, window: int) -> DataFrame:
    """Centred means over an odd window on a ring of bins: each value is dealt to its neighbours and averaged there.

    A window of 1 leaves values as they are, one of the ring's size or more gives their mean; an even one is an error. The mean of
    the bins stays. Places without a bin take no part.
    """
    if window > 1 and window % 2 == 0:
        raise ValueError(f"an odd window is needed, not {window}")
    if window <= 1:
        return bins.select(*keys, place, value)
    whole = Window.partitionBy(*keys)
    if window >= size:
        return bins.select(*keys, place, F.avg(value).over(whole).alias(value))
    half, (to, mean) = window // 2, fresh_name(bins, "to", "mean")
    marked = bins.withColumn(mean, F.avg(value).over(whole))
    dealt = marked.select(*keys, mean, F.explode(F.sequence(F.col(place) - half, F.col(place) + half)).alias(to), value)
    smooth = dealt.groupBy(*keys, F.pmod(to, F.lit(size)).alias(place)).agg(F.avg(value).alias(value), F.first(mean).alias(mean))
    return smooth.select(*keys, place, (F.col(value) - F.avg(value).over(whole) + F.col(mean)).alias(value))


def lagged_moments(series: DataFrame, keys: list[str], value: str, lags: list[int]) -> DataFrame:
    """keys, lag, acf of a series without gaps, against its own mean; null where it doesn't vary."""
    names = fresh_name(series, "centred", *[f"lag_{k}" for k in lags])
    c, by = names[0], dict(zip(lags, names[1:]))
    centred = series.withColumn(c, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    order = Window.partitionBy(*keys).orderBy("ts")
    wide = centred.select(*keys, c, *[F.lag(c, k).over(order).alias(by[k]) for k in lags])
    sums = wide.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(c) * F.col(by[k])), F.nullif(F.sum(F.col(c) * F.col(c)), F.lit(0.0))).alias(by[k]) for k in lags])
    return sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(by[k]).alias("acf")) for k in lags])).alias("x")).select(*keys, "x.*")


def episodes(series: DataFrame, keys: list[str], flag: Column, least: int = 1, at: int | None = None) -> DataFrame:
    """keys, start, hours of each run of rows where flag holds, and the time of its at-th row; a null flag ends a run."""
    hit, run, place = fresh_name(series, "hit", "run", "place")
    order = Window.partitionBy(*keys).orderBy("ts")
    marked = series.withColumn(hit, F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn(run, F.row_number().over(order) - F.sum(F.col(hit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.filter(hit).withColumn(place, F.row_number().over(Window.partitionBy(*keys, run).orderBy("ts")))
    told = found.groupBy(*keys, run).agg(F.min("ts").alias("start"), F.count("*").alias("hours"), F.max(F.when(F.col(place) == (at or least), F.col("ts"))).alias("at"))
    return told.filter(F.col("hours") >= least).drop(run, *([] if at else ["at"]))


def gram(rows: DataFrame, target: str, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Sums of products of 1, features and target: one row a key, made by one aggregate with partial sums."""
    terms = {"one": F.lit(1.0), **{f: F.col(f) for f in features}, "target": F.col(target)}
    names = list(terms)
    return rows.groupBy(*(keys or [])).agg(*[F.sum(terms[a] * terms[b]).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]])


def ridge(rows: DataFrame, target: str, features: list[str], alpha: float = 0.0) -> dict[str, float]:
    """Coefficients and intercept of least squares with a penalty on all but the intercept; the driver solves the sums.

    Rows with a null are left out. Without a row all are 0. Where the features don't tell their parts apart, the shortest solution.
    """
    import numpy as np

    sums = gram(rows.na.drop(subset=[target, *features]), target, features).first().asDict()
    names = ["one", *features]
    at = lambda a, b: sums.get(f"{a}__{b}", sums.get(f"{b}__{a}")) or 0.0
    left = np.array([[at(a, b) for b in names] for a in names], float) + alpha * np.diag([0.0] + [1.0] * len(features))
    return dict(zip(["intercept", *features], np.linalg.lstsq(left, np.array([at(a, "target") for a in names], float))[0].tolist()))
