"""Forecasts against what came: ledgers, bands, relative errors by lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name
from gridloom.operators.align import latest

# The relative price error to start from, by days of lead; beyond the last it stays.
PRIOR = [0.0, 0.0, 0.10, 0.15, 0.20, 0.25, 0.30]
LEAST_PRICE, WARM, WEIGHT = 1e-3, 10, 0.3


def static_bands(rows: DataFrame, keys: list[str], coverage: float, window: int, warm: int) -> DataFrame:
    """rows (ts, actual, pred) with lower, upper, hit: bands of the last ``window`` errors' quantile; rows with fewer than ``warm`` are left out.

    keys and ts name a row.
    """
    from gridloom.operators.sliding import by_rows

    n, q, e = fresh_name(rows, "n", "q", "error")
    error = F.abs(F.col("actual") - F.col("pred"))
    before = by_rows(rows.withColumn(e, error), keys, e, window, coverage).withColumnsRenamed({"n": n, "level_value": q})
    told = rows.join(before, [*keys, "ts"]).filter(F.col(n) >= warm)
    return told.withColumns({"lower": F.col("pred") - F.col(q), "upper": F.col("pred") + F.col(q), "hit": error <= F.col(q)}).drop(n, q)


def pinball(score: Column, level: Column, alpha: float) -> Column:
    """The loss of a score against the quantile at 1 - alpha."""
    return F.when(score >= level, alpha * (score - level)).otherwise((1 - alpha) * (level - score))


def entropy_bits(weights: Column) -> Column:
    """The entropy of an array of weights in bits; weights near 0 add nothing."""
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s - F.when(w > 1e-12, w * F.log2(w)).otherwise(0.0))


def relative_errors(rows: DataFrame, keys: list[str], forecast: str, realised: str) -> DataFrame:
    """keys, error: the root mean square of (realised - forecast) / forecast; forecasts near 0 take no part, and a key without any is left out."""
    usable = rows.filter((F.abs(forecast) > LEAST_PRICE) & F.col(realised).isNotNull())
    return usable.groupBy(*keys).agg(F.sqrt(F.avg(F.pow((F.col(realised) - F.col(forecast)) / F.col(forecast), 2))).alias("error"))


def learned_errors(samples: DataFrame, lead: str, day: str, weight: float = WEIGHT) -> DataFrame:
    """lead, n, learned: the samples' exponential mean in order of days, starting at the first."""
    from gridloom.streaming.online import ordered_walk

    def step(state: list, _, error: float) -> None:
        state[:] = [error if state[0] is None else (1 - weight) * state[0] + weight * error, state[1] + 1]

    return ordered_walk(samples, [lead], [day], ["error"], lambda: [None, 0], step, "n long, learned double", lambda s: (s[1], s[0]))


def prior_error(lead: Column) -> Column:
    """The relative error to start from, by days of lead: those below 0 count as 0, those beyond the last as the last. A null lead counts as 0."""
    return F.element_at(F.array(*[F.lit(x) for x in PRIOR]), F.least(F.greatest(lead, F.lit(0)) + 1, F.lit(len(PRIOR))).cast("int"))


def published_error(lead: Column, n: Column, learned: Column, warm: int = WARM) -> Column:
    """The learned error blended with the prior, by how many samples there are; the prior alone without any."""
    w = F.coalesce(n, F.lit(0)) / (F.coalesce(n, F.lit(0)) + warm)
    return (1 - w) * prior_error(lead) + w * F.coalesce(learned, prior_error(lead))


def reconciled(made: DataFrame, actuals: DataFrame, fed: DataFrame, keys: list[str]) -> DataFrame:
    """Forecasts with the actuals that have met them, without those in fed."""
    return made.join(actuals, keys).join(fed, keys, "left_anti")


def ledger(told: DataFrame, keys: list[str], order: list[str], days: int, ts: str = "ts") -> DataFrame:
    """The last row told for each key, none whose ts is more than so many days older than the newest telling."""
    (newest,) = fresh_name(told, "newest")
    end = told.agg(F.max(order[0]).alias(newest))
    return latest(told, keys, *order).crossJoin(F.broadcast(end)).filter(F.col(ts) >= F.col(newest) - F.expr(f"interval {days} days")).drop(newest)
