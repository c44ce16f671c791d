"""Ranks, blocks and shares within days, and scores of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name


def blocks(hours: DataFrame, keys: list[str], values: list[str], length: int = 4) -> DataFrame:
    """keys, start and the mean of each value over each run of ``length`` rows, in order of ``hour``."""
    run = Window.partitionBy(*keys).orderBy("hour").rowsBetween(0, length - 1)
    (n,) = fresh_name(hours, "n")
    return hours.select(*keys, F.col("hour").alias("start"), *[F.avg(v).over(run).alias(v) for v in values], F.count("*").over(run).alias(n)).filter(F.col(n) == length).drop(n)


def block_choice(hours: DataFrame, keys: list[str], actual: str, pred: str, length: int = 4) -> DataFrame:
    """keys, chosen, best, place, regret: the block that the forecast thinks cheapest, the cheapest, the rank of the chosen one by actual
    price, and how much dearer it was, in percent of the best block's price (null where that is 0). Ties go to the earlier block."""
    means = blocks(hours, keys, [actual, pred], length)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(actual))
    told = means.withColumn("place", rank).groupBy(*keys).agg(F.min(F.struct(pred, "start", actual, "place")).alias("c"), F.min(F.struct(actual, "start")).alias("b"))
    best = F.col("b")[actual]
    return told.select(*keys, F.col("c.start").alias("chosen"), F.col("b.start").alias("best"), F.col("c.place").alias("place"), F.try_divide(100 * (F.col("c")[actual] - best), F.abs(best)).alias("regret"))


def block_concordance(hours: DataFrame, keys: list[str], actual: str, pred: str, length: int = 4, gap: float = 5.0) -> DataFrame:
    """keys, pairs, concordant: of a day's blocks that don't overlap (every ``length`` hours), two whose prices differ by ``gap`` or more, and how
    many such pairs the forecast has in the same order. Pairs are made within an array of a day's few blocks."""
    means = blocks(hours, keys, [actual, pred], length).filter(F.col("start") % length == 0)
    held = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", F.col(actual).alias("a"), F.col(pred).alias("p")))).alias("b"))
    two = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice(F.col("b"), i + 2, F.size("b")), lambda y: F.struct((y["a"] - x["a"]).alias("a"), (y["p"] - x["p"]).alias("p")))))
    told = held.withColumn("two", F.filter(two, lambda d: F.abs(d["a"]) >= gap))
    return told.select(*keys, F.size("two").alias("pairs"), F.size(F.filter("two", lambda d: d["a"] * d["p"] > 0)).alias("concordant"))


def shares_by_rank(hours: DataFrame, keys: list[str], order: str, amount: str) -> DataFrame:
    """place, share: of all amounts, what falls on each rank (from 0) by ``order`` within a day."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "hour")) - 1
    sums = hours.withColumn("place", place).groupBy("place").agg(F.sum(amount).alias("s"))
    return sums.select("place", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("share"))  # a row a rank


def share_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: l1, largest, top4: how far two tables of (place, share) lie apart; a place that one lacks has 0 there."""
    both = a.select("place", F.col("share").alias("x")).join(b.select("place", F.col("share").alias("y")), "place", "full")
    d = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    return both.agg(F.sum(F.abs(d)).alias("l1"), F.max(F.abs(d)).alias("largest"), F.abs(F.sum(F.when(F.col("place") < 4, d))).alias("top4"))


def bin_number(value: Column, low: float, width: float, bins: int) -> Column:
    """The bin of a value from 0 to bins - 1; those beyond the ends count to the ends."""
    return F.greatest(F.least(F.floor((value - low) / width), F.lit(bins - 1)), F.lit(0))


def density(edges: DataFrame, keys: list[str], quantiles: str, levels: list[float], low: float, high: float, width: float) -> DataFrame:
    """keys, bin, mass: the mass between neighbouring quantiles of an array, spread evenly over the bins that it covers.

    Each stretch is dealt to its own bins, so no two sides are paired. A stretch without length puts its mass into one bin; what lies beyond low and high
    is left out.
    """
    bins = int(round((high - low) / width))
    stretch = F.transform(F.sequence(F.lit(1), F.lit(len(levels) - 1)), lambda i: F.struct(F.get(F.col(quantiles), i - 1).alias("a"), F.get(F.col(quantiles), i).alias("b"), (F.get(F.array(*[F.lit(x) for x in levels]), i) - F.get(F.array(*[F.lit(x) for x in levels]), i - 1)).alias("m")))
    each = edges.select(*keys, F.explode(stretch).alias("s")).select(*keys, "s.*").filter("a is not null and b is not null")
    first, last = F.floor((F.col("a") - low) / width).cast("int"), F.floor((F.col("b") - low) / width).cast("int")
    dealt = each.select(*keys, "a", "b", "m", F.explode(F.sequence(first, F.greatest(last, first))).alias("bin"))
    edge = low + F.col("bin") * width
    part = F.when(F.col("b") > F.col("a"), (F.least(F.col("b"), edge + width) - F.greatest(F.col("a"), edge)) / (F.col("b") - F.col("a"))).otherwise(F.lit(1.0))
    return dealt.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.sum(F.col("m") * F.greatest(part, F.lit(0.0))).alias("mass"))
