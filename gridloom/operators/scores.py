"""How good forecasts are, and what tails cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name


def headline() -> list[Column]:
    """Aggregates over actual and pred: n, mae, rmse, bias (actual less forecast), r2 (0 where actuals don't vary), low, high.

    Rows where either is null count in n alone.
    """
    error = F.col("actual") - F.col("pred")
    spread = F.var_pop(F.when(F.col("pred").isNotNull(), F.col("actual")))
    r2 = F.when(spread > 0, 1 - F.try_divide(F.avg(error * error), spread)).otherwise(F.lit(0.0))
    return [
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), r2.alias("r2"), F.min("actual").alias("low"), F.max("actual").alias("high")
    ]


def average_rank(keys: list[str], column: str) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs."""
    ordered, same = Window.partitionBy(*keys).orderBy(column), Window.partitionBy(*keys, column)
    return F.rank().over(ordered) + (F.count("*").over(same) - 1) / 2


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, rho: the correlation of average ranks; null where a side doesn't vary. Rows with a null on either side are left out."""
    x, y = fresh_name(rows, "rank_a", "rank_b")
    ranked = rows.na.drop(subset=[a, b]).withColumn(x, average_rank(keys, a)).withColumn(y, average_rank(keys, b))
    return ranked.groupBy(*keys).agg(F.corr(x, y).alias("rho"))


def value_at_risk(losses: DataFrame, keys: list[str], loss: str, alpha: float = 0.05, accuracy: int | None = None) -> DataFrame:
    """keys, value_at_risk (the 1 - alpha quantile) and cvar (the mean of the losses from there on).

    The exact quantile holds a key's distinct losses in memory. For keys of very many, accuracy takes Spark's sketch instead, whose
    quantile is a loss of a rank within 1 / accuracy of the wanted one.
    """
    level = F.percentile(loss, 1 - alpha) if accuracy is None else F.percentile_approx(loss, 1 - alpha, accuracy)
    var = losses.groupBy(*keys).agg(level.alias("value_at_risk"))
    # a row a key goes back to the losses
    return losses.join(var, keys).filter(F.col(loss) >= F.col("value_at_risk")).groupBy(*keys).agg(F.first("value_at_risk").alias("value_at_risk"), F.avg(loss).alias("cvar"))


def hill(values: DataFrame, keys: list[str], value: str, top: int) -> DataFrame:
    """The Hill estimate of the tail index from the largest ``top`` absolute values of each key; null with fewer than top + 1."""
    size, place = fresh_name(values, "size", "place")
    by = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(size))
    tail = values.select(*keys, F.abs(value).alias(size)).withColumn(place, F.row_number().over(by)).filter(F.col(place) <= top + 1)
    return tail.groupBy(*keys).agg((F.avg(F.when(F.col(place) <= top, F.ln(size))) - F.max(F.when(F.col(place) == top + 1, F.ln(size)))).alias("xi"))


def in_order(rows: DataFrame, order: str, place: str, count: str) -> DataFrame:
    """rows with their place from 0 in order of a time, and the count of all.

    Counts by day, added up in order, tell each day's first place; rows are numbered within their days, so no task orders all rows.
    """
    day, at = fresh_name(rows, "day", "at")
    dated = rows.withColumn(day, F.to_date(order))
    counts = dated.groupBy(day).agg(F.count("*").alias(count))
    starts = counts.select(day, (F.sum(count).over(Window.partitionBy().orderBy(day)) - F.col(count)).alias(at), F.sum(count).over(Window.partitionBy()).alias(count))  # a row a day
    return dated.join(starts, day).withColumn(place, F.col(at) + F.row_number().over(Window.partitionBy(day).orderBy(order)) - 1).drop(day, at)


def quarters(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``quarter`` (1 to 4): slices of as many rows each in order of a time, the last with the rest."""
    place, count = fresh_name(rows, "place", "count")
    step = F.greatest(F.floor(F.col(count) / 4), F.lit(1))
    return in_order(rows, order, place, count).withColumn("quarter", F.least(F.floor(F.col(place) / step), F.lit(3)).cast("long") + 1).drop(place, count)


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight))


def weighted_sd(value: str, weight: str) -> Column:
    """An aggregate: the weighted spread about the weighted mean."""
    square = F.try_divide(F.sum(F.col(weight) * F.col(value) * F.col(value)), F.sum(weight))
    return F.sqrt(F.greatest(square - F.pow(weighted_mean(value, weight), F.lit(2)), F.lit(0.0)))
