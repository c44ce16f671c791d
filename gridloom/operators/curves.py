"""Duration curves: mean price of the k cheapest and k dearest hours of a day, and what goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_days(hourly: DataFrame, keys: list[str], hours: int = 24) -> DataFrame:
    """The rows of days (by keys) that have just so many rows with a price."""
    return hourly.withColumn("day_rows", F.count("p").over(Window.partitionBy(*keys))).filter(F.col("day_rows") == hours).drop("day_rows")


def duration_curves(hourly: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """keys, k, cheap, peak for k from 1 to most: means of the k cheapest and dearest hours. Ties are taken by hour."""
    up = Window.partitionBy(*keys).orderBy("p", "hour")
    down = Window.partitionBy(*keys).orderBy(F.desc("p"), "hour")
    first = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cheap = hourly.select(*keys, F.row_number().over(up).alias("k"), F.avg("p").over(first(up)).alias("cheap"))
    peak = hourly.select(*keys, F.row_number().over(down).alias("k"), F.avg("p").over(first(down)).alias("peak"))
    # both windows deal the rows by the same keys, so the join adds no exchange
    return cheap.join(peak, [*keys, "k"]).filter(F.col("k") <= most)


def sorted_prices(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The k-th price from a curve of means: k D(k) - (k - 1) D(k - 1)."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy("k")), F.lit(0.0))
    return curve.select(*keys, "k", (F.col("k") * F.col(value) - (F.col("k") - 1) * before).alias("price"))


def _pooled(blocks: Column, value: Column) -> Column:
    """Blocks (sum, n) of rising means with one more value: it takes in the blocks before it, from the last, whose mean is above its own."""
    start = F.struct(value.alias("sum"), F.lit(1).alias("n"), F.lit(False).alias("done"), F.slice(blocks, 1, 0).alias("kept"))

    def back(cur: Column, block: Column) -> Column:
        stop = cur["done"] | (block["sum"] * cur["n"] < cur["sum"] * block["n"])
        kept = F.when(stop, F.array_append(cur["kept"], block)).otherwise(cur["kept"])
        more = lambda c: cur[c] + F.when(stop, F.lit(0)).otherwise(block[c])
        return F.struct(more("sum").alias("sum"), more("n").alias("n"), stop.alias("done"), kept.alias("kept"))

    return F.aggregate(F.reverse(blocks), start, back, lambda cur: F.array_append(F.reverse(cur["kept"]), F.struct(cur["sum"].alias("sum"), cur["n"].alias("n"))))


def isotonic(values: DataFrame, keys: list[str], order: str, value: str, increasing: bool = True) -> DataFrame:
    """values with ``fitted``, the closest monotone sequence, by pooling adjacent violators in one fold over a key's values.

    A key is a short sequence (a day's curve), gathered in one array. Rows without a value are left out; ties of the order are taken
    by value.
    """
    sign = 1.0 if increasing else -1.0
    known = values.filter(F.col(value).isNotNull())
    rows = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (sign * F.col(value)).alias("v")))).alias("s"))
    none = F.array().cast("array<struct<sum:double,n:int>>")
    blocks = F.aggregate("s", none, lambda done, x: _pooled(done, x["v"]))
    fitted = F.flatten(F.transform(blocks, lambda b: F.array_repeat(b["sum"] / b["n"], b["n"])))
    each = rows.select(*keys, F.explode(F.arrays_zip("s", fitted.alias("f"))).alias("x"))
    return each.select(*keys, F.col("x.s.o").alias(order), (sign * F.col("x.s.v")).alias(value), (sign * F.col("x.f")).alias("fitted"))


def cheapest_block(hourly: DataFrame, keys: list[str], length: int = 4) -> DataFrame:
    """keys, start, mean: the run of ``length`` hours with the least mean price, the first of equal ones."""
    run = Window.partitionBy(*keys).orderBy("hour").rowsBetween(0, length - 1)
    means = hourly.select(*keys, F.col("hour").alias("start"), F.avg("p").over(run).alias("mean"), F.count("p").over(run).alias("n")).filter(F.col("n") == length)
    return means.groupBy(*keys).agg(F.min(F.struct("mean", "start")).alias("b")).select(*keys, "b.start", "b.mean")


def segments(hours: DataFrame) -> DataFrame:
    """hours (hour) with ``segment``: night, morning, midday or evening, of six hours each."""
    return hours.withColumn("segment", F.when(F.col("hour") < 6, "night").when(F.col("hour") < 12, "morning").when(F.col("hour") < 18, "midday").otherwise("evening"))


def merged_segments(part: DataFrame, keys: list[str], segment: str, most: int = 12) -> DataFrame:
    """keys, k, cheap, peak for k to ``most``: the curves of whole days from those of their segments (keys, segment, k, cheap, peak).

    A segment's curves are made monotone, then turned back into prices; a day's prices are sorted anew and averaged. A day without peak
    curves takes its cheap prices from above.
    """
    by = [*keys, segment]
    rising = sorted_prices(isotonic(part.select(*by, "k", "cheap"), by, "k", "cheap").select(*by, "k", "fitted"), by, "fitted")
    falling = sorted_prices(isotonic(part.select(*by, "k", "peak"), by, "k", "peak", False).select(*by, "k", "fitted"), by, "fitted")
    up, down = Window.partitionBy(*keys).orderBy("price", segment, "k"), Window.partitionBy(*keys).orderBy(F.desc("price"), segment, "k")
    mean = lambda w: F.avg("price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cheap = rising.select(*keys, F.row_number().over(up).alias("k"), mean(up).alias("cheap"), F.row_number().over(down).alias("j"), mean(down).alias("turned"))
    peak = falling.select(*keys, F.row_number().over(down).alias("k"), mean(down).alias("peak"))
    turned = cheap.select(*keys, F.col("j").alias("k"), "turned")
    joined = cheap.select(*keys, "k", "cheap").join(turned, [*keys, "k"]).join(peak, [*keys, "k"], "left")
    return joined.filter(F.col("k") <= most).select(*keys, "k", "cheap", F.coalesce("peak", "turned").alias("peak"))
