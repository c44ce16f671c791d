"""Lagged, smoothed and resampled views of keyed series (keys, ts, value), and what lags tell of two series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts")


def lagged_mean(keys: list[str], value: str, lag: int, rows: int, least: int) -> Column:
    """The mean of ``rows`` rows that end ``lag`` rows before; null with fewer than ``least`` values."""
    window = _order(keys).rowsBetween(-lag - rows + 1, -lag)
    return F.when(F.count(value).over(window) >= least, F.avg(value).over(window))


def centred_mean(keys: list[str], value: str, rows: int) -> Column:
    """The mean of ``rows`` rows around each, where there are as many; elsewhere the nearest such mean, that before it first.

    Of an even number, one more row lies before than behind.
    """
    before, after = rows // 2, rows - 1 - rows // 2
    return F.when(F.count(value).over(_order(keys).rowsBetween(-before, after)) == rows, F.avg(value).over(_order(keys).rowsBetween(-before, after)))


def filled(keys: list[str], value: str) -> Column:
    """The value, or the last one before, or the first one behind."""
    before = F.last(value, ignorenulls=True).over(_order(keys).rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(before, F.first(value, ignorenulls=True).over(_order(keys).rowsBetween(0, Window.unboundedFollowing)))


def ewm(keys: list[str], value: str, span: int, rows: int | None = None) -> Column:
    """The exponentially weighted mean of the rows so far, weights adjusted to add up to one.

    It looks at ``rows`` rows at most: by default 15 spans, beyond which the weights add up to less than 1e-12. Nulls take no part.
    """
    keep = 1 - 2 / (span + 1)
    seen = F.collect_list(F.coalesce(F.col(value), F.lit(float("nan")))).over(_order(keys).rowsBetween(1 - (rows or 15 * span), 0))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"))
    step = lambda s, x: F.struct(
        (s["sum"] * keep + F.when(F.isnan(x), 0.0).otherwise(x)).alias("sum"), (s["weight"] * keep + F.when(F.isnan(x), 0.0).otherwise(1.0)).alias("weight")
    )
    return F.aggregate(seen, zero, step, lambda s: F.try_divide(s["sum"], s["weight"]))


def convolved(keys: list[str], value: str, kernel: list[float]) -> Column:
    """The values around each row times a kernel of odd length; beyond the ends there are zeros."""
    half = len(kernel) // 2
    at = lambda k: F.lag(value, k) if k > 0 else F.lead(value, -k)
    terms = [w * F.coalesce(at(k).over(_order(keys)), F.lit(0.0)) for k, w in zip(range(-half, half + 1), kernel)]
    return sum(terms[1:], terms[0])


def trapezoid(n: int) -> list[float]:
    """n weights that rise over a quarter, stay, fall over a quarter, and add up to 1; n is made odd."""
    n |= 1
    ramp = max(1, n // 4)
    raw = [min(1.0, (i + 1) / (ramp + 1), (n - i) / (ramp + 1)) for i in range(n)]
    return [x / sum(raw) for x in raw]


def interpolated(series: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """An hourly grid's missing values on the line between their neighbours, up to ``most`` in a row behind a value; the rest stay null."""
    at, lo, hi, low, high = fresh_name(series, "at", "lo", "hi", "low", "high")
    so_far, onward = _order(keys).rowsBetween(Window.unboundedPreceding, 0), _order(keys).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    wide = series.withColumn(at, (F.unix_timestamp("ts") / 3600).cast("long")).withColumns(
        {lo: F.max(known).over(so_far), hi: F.min(known).over(onward), low: F.last(value, ignorenulls=True).over(so_far), high: F.first(value, ignorenulls=True).over(onward)}
    )
    between = F.col(low) + (F.col(high) - F.col(low)) * F.try_divide(F.col(at) - F.col(lo), F.col(hi) - F.col(lo))
    out = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col(at) - F.col(lo) <= most, between)
    return wide.withColumn(value, out).drop(at, lo, hi, low, high)


def cross_correlation(series: DataFrame, keys: list[str], a: str, b: str, lags: list[int]) -> DataFrame:
    """keys, lag, corr of a with b so many rows before (behind, where negative); null where either doesn't vary."""
    at = lambda k: F.lag(b, k) if k >= 0 else F.lead(b, -k)
    names = dict(zip(lags, fresh_name(series, *[f"at_{k}".replace("-", "m") for k in lags])))
    wide = series.select(*keys, a, *[at(k).over(_order(keys)).alias(names[k]) for k in lags])
    each = wide.groupBy(*keys).agg(*[F.corr(a, names[k]).alias(names[k]) for k in lags])
    return each.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(names[k]).alias("corr")) for k in lags])).alias("x")).select(*keys, "x.*")


def ljung_box(series: DataFrame, keys: list[str], value: str, lags: int = 24) -> DataFrame:
    """keys, n, q: n (n + 2) times the sum of r_k^2 / (n - k), with r_k = sum of products / ((n - k) variance).

    Null where the series doesn't vary or has no more rows than lags.
    """
    c, *names = fresh_name(series, "centred", *[f"lag_{k}" for k in range(1, lags + 1)])
    centred = series.withColumn(c, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    wide = centred.select(*keys, c, *[F.lag(c, k + 1).over(_order(keys)).alias(name) for k, name in enumerate(names)])
    n = F.count(c)
    r = [F.try_divide(F.sum(F.col(c) * F.col(name)), (n - k) * F.avg(F.col(c) * F.col(c))) for k, name in enumerate(names, 1)]
    terms = [F.try_divide(x * x, n - k) for k, x in enumerate(r, 1)]
    return wide.groupBy(*keys).agg(n.alias("n"), F.when(n > lags, n * (n + 2) * sum(terms[1:], terms[0])).alias("q"))


def block_starts(series: DataFrame, keys: list[str], hours: int = 24) -> DataFrame:
    """keys, ts of each row that starts a run of so many hours without a gap."""
    last = F.lead("ts", hours - 1).over(_order(keys))
    return series.withColumn("last", last).filter(F.unix_timestamp("last") - F.unix_timestamp("ts") == (hours - 1) * 3600).select(*keys, "ts")


def lead_day(ts: Column, origin: Column) -> Column:
    """How many days, begun ones whole, a time lies behind an origin."""
    return F.ceil((F.unix_timestamp(ts) - F.unix_timestamp(origin)) / 86_400)


def profile(series: DataFrame, keys: list[str], value: str, bins: dict[str, tuple[Column, int]]) -> DataFrame:
    """keys, part, bin, mean: seasonal parts one after the other, each a mean by bin of what the ones before leave."""
    (left,) = fresh_name(series, "left")
    rows, out = series.withColumn(left, F.col(value)), None
    for name, (place, _) in bins.items():
        means = rows.groupBy(*keys, place.alias("bin")).agg(F.avg(left).alias("mean")).select(*keys, F.lit(name).alias("part"), "bin", "mean")
        out = means if out is None else out.unionByName(means)
        rows = rows.withColumn(left, F.col(left) - F.avg(left).over(Window.partitionBy(*keys, place)))
    return out


def nearest_filled(means: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, bin, mean for every bin from 0 to size - 1: those not seen take the nearest seen one, of two the lower.

    means: keys, bin, mean, a few rows a key.
    """
    seen = means.groupBy(*keys).agg(F.collect_list(F.struct("bin", "mean")).alias("seen"))
    every = seen.select(*keys, "seen", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("bin"))
    best = F.array_min(F.transform("seen", lambda s: F.struct(F.abs(s["bin"] - F.col("bin")).alias("d"), s["bin"].alias("b"), s["mean"].alias("m"))))
    return every.select(*keys, "bin", best["m"].alias("mean"))


def seasonal_part(rows: DataFrame, keys: list[str], parts: DataFrame, bins: dict[str, Column]) -> DataFrame:
    """rows with ``seasonal``: the sum of their bins' means. A part or bin that isn't in parts (keys, part, bin, mean) counts as 0.

    parts holds 84 rows a key at most; each key's go into one map, so that rows need one join.
    """
    held = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "part", "bin"), "mean"))).alias("parts"))
    joined = rows.join(held, keys, "left") if keys else rows.crossJoin(F.broadcast(held))
    at = lambda name, place: F.coalesce(F.try_element_at("parts", F.concat_ws(":", F.lit(name), place)), F.lit(0.0))
    terms = [at(name, place) for name, place in bins.items()]
    return joined.withColumn("seasonal", sum(terms[1:], terms[0])).drop("parts")
