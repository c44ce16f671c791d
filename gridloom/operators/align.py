"""Joins on time: grids, as-of, intervals, lags, gaps, latest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name


#: Hours of a range of time that one task works through at once.
RANGE_HOURS = 24 * 14


def hour_grid(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ts for every hour from each key's first to its last."""
    ends = hourly.groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return ends.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("ts"))


def forward_fill(hourly: DataFrame, keys: list[str], value: str, range_hours: int = RANGE_HOURS) -> DataFrame:
    """A row for every hour of the grid; missing values take the last one before. Cut in ranges of time, see ``carried``."""
    return carried(hour_grid(hourly, keys).join(hourly, [*keys, "ts"], "left"), keys, value, ["ts"], range_hours)


def carried(rows: DataFrame, keys: list[str], value: str, order: list[str], range_hours: float = RANGE_HOURS, how=None) -> DataFrame:
    """rows whose value is the last one that isn't null up to each row, by ``order``, whose first column is a timestamp.

    A key's rows are cut into ranges of time. Each range's own last value is an aggregate; those of a key, one row a range, are scanned in
    order, and what comes before a range enters it as its first row. So one key's rows are shared by as many tasks as it has ranges,
    and what a single task sees of a whole key is a row a range. how: another aggregate over a window in place of the last value, such as
    F.max, whose result over ranges is that over their results. Rows without a timestamp keep their value and give none to others.
    """
    span, first, own, before = fresh_name(rows, "span", "first", "own", "before")
    cut = rows.withColumn(span, F.floor(F.unix_timestamp(order[0]) / (3600 * range_hours)))
    known, place = F.col(value).isNotNull() & F.col(span).isNotNull(), F.struct(*order)
    whole = how(F.col(value)) if how else F.max_by(F.when(known, F.col(value)), F.when(known, place))
    ends = cut.filter(F.col(span).isNotNull()).groupBy(*keys, span).agg(whole.alias(own))
    over = lambda c, w: (how(F.col(c)) if how else F.last(c, ignorenulls=True)).over(w)
    scan = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*keys, span, over(own, scan).alias(value)).filter(F.col(value).isNotNull()).withColumn(first, F.lit(0))
    both = cut.withColumn(first, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, span).orderBy(first, *[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(before, F.when(F.col(span).isNull(), F.col(value)).otherwise(over(value, so_far)))
    return found.filter(F.col(first) == 1).select(*[F.col(before).alias(c) if c == value else c for c in rows.columns])


def gap_ranges(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap_start, gap_hours of each run of missing hours."""
    after = F.lead("ts").over(Window.partitionBy(*keys).orderBy("ts"))
    gaps = hourly.select(*keys, "ts", ((F.unix_timestamp(after) - F.unix_timestamp("ts")) / 3600 - 1).cast("long").alias("gap_hours")).filter(F.col("gap_hours") > 0)
    return gaps.select(*keys, (F.col("ts") + F.expr("interval 1 hour")).alias("gap_start"), "gap_hours")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str, tie: str, range_hours: float = RANGE_HOURS) -> DataFrame:
    """left with the value of right's last row (by ts, then tie) at or before its ts; null where there is none. Nulls are passed over, and rows
    of right without a ts take no part.

    Where left has a column of the value's name, the new one gets an underscore in front. Both sides are laid together and cut in ranges of time
    (see ``carried``), so no pairs are made and a key with any share of the rows is many tasks' work.
    """
    got, side, order = fresh_name(left, value, "side", "tie")
    told = right.filter(F.col("ts").isNotNull()).select(*keys, "ts", F.col(value).alias(got), F.col(tie).alias(order)).withColumn(side, F.lit(0))
    both = left.withColumn(side, F.lit(1)).unionByName(told, allowMissingColumns=True)
    return carried(both, keys, got, ["ts", side, order], range_hours).filter(F.col(side) == 1).select(*left.columns, got)


def revision_at(wanted: DataFrame, facts: DataFrame, keys: list[str], value: str, tie: str, range_hours: float = RANGE_HOURS) -> DataFrame:
    """wanted (keys, ts, origin, ..) with the value that facts (keys, ts, told, value) had for ts when it was origin: of what had been told by
    then, the last (by told, then tie). Null where nothing had been told; a later revision never changes it.

    ts is the time that a fact is about, told the time from which it is known: an as-of join by told for each (keys, ts).
    """
    got, about = fresh_name(wanted, value, "about")
    left = wanted.withColumnsRenamed({"ts": about, "origin": "ts"})
    right = facts.select(*keys, F.col("ts").alias(about), F.col("told").alias("ts"), F.col(value).alias(got), F.col(tie).alias("_tie"))
    return as_of(left, right, [*keys, about], got, "_tie", range_hours).withColumnsRenamed({"ts": "origin", about: "ts"}).select(*wanted.columns, got)


def newest_at(origins: DataFrame, facts: DataFrame, keys: list[str], value: str, tie: str, range_hours: float = RANGE_HOURS) -> DataFrame:
    """origins (keys, origin, ..) with newest, the latest ts that facts had told of by then, and the value told of it last by then.

    A greatest (ts, told, tie) so far in order of told, so it can be cut in ranges as well. Facts with a null among ts, told and value take no part.
    """
    got, about, side, best = fresh_name(origins, value, "newest", "side", "best")
    told = facts.dropna(subset=["ts", "told", value]).select(*keys, F.col("told").alias("origin"), F.struct(F.col("ts").alias("a"), F.col("told").alias("b"), F.col(tie).alias("c"), F.col(value).alias("v")).alias(best)).withColumn(side, F.lit(0))
    both = origins.withColumn(side, F.lit(1)).unionByName(told, allowMissingColumns=True)
    out = carried(both, keys, best, ["origin", side], range_hours, F.max).filter(F.col(side) == 1)
    return out.select(*origins.columns, F.when(F.col("origin").isNotNull(), F.col(best)["a"]).alias(about), F.when(F.col("origin").isNotNull(), F.col(best)["v"]).alias(got))


def time_lag(series: DataFrame, keys: list[str], value: str, hours: int, out: str) -> DataFrame:
    """series with the value so many hours before, by time and not by row, so that gaps give nulls."""
    past = series.select(*keys, (F.col("ts") + F.expr(f"interval {hours} hours")).alias("ts"), F.col(value).alias(out))
    return series.join(past, [*keys, "ts"], "left")


def _one_of_each(rows: DataFrame, keys: list[str], order: tuple[str, ...], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    (best,) = fresh_name(rows, "best")
    found = rows.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias(best))
    return found.select(*[c if c in keys else F.col(best)[c].alias(c) for c in rows.columns])


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """For each key the row with the greatest values of the order columns; of equal ones, the greatest in all columns.

    An aggregate, so that rows of a key meet beforehand where they are and only one of them is exchanged. Nulls are least.
    """
    return _one_of_each(rows, keys, order, F.max)


def earliest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """For each key the row with the least values of the order columns, likewise."""
    return _one_of_each(rows, keys, order, F.min)


def active_per_day(intervals: DataFrame, start: str, stop: str, amount: str) -> DataFrame:
    """day, active, total over intervals [start, stop): each interval is dealt to its days, then added up."""
    days = intervals.filter(F.col(start) < F.col(stop)).select(F.explode(F.sequence(F.col(start), F.date_sub(F.col(stop), 1))).alias("day"), amount)
    return days.groupBy("day").agg(F.count("*").alias("active"), F.sum(amount).alias("total"))
