"""Two-layer models refitted every period on all rows before it, from prefix sums of sufficient statistics.

The first layer are seasonal parts of each column: means by one bin of time, then of what these leave by the next. The second is a ridge of the
target's remainder on the features' remainders, and the memory of its errors (AR(1)). A refit needs no rows: seasonal parts follow
from sums by bin and counts by pairs of bins, and sums of products of remainders from those of the raw columns, from sums of each
column by each bin, and from the same counts. All are sums, so one pass makes them by period, and adding them up in order gives
every period's model. A lagged column has its season at its own time, so its bins are bins of the lagged time.

What a key's statistics amount to is bounded by periods and bins, and not by rows; keys are solved side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.fits import ridge_of
from gridloom.session import settled

MODEL = "period timestamp, n long, intercept double, coef array<double>, phi double, parts array<array<double>>"


@dataclass(frozen=True)
class Bin:
    """A bin of time: its number (from 0) as an expression of a timestamp, and how many there are."""

    of: Callable[[Column], Column]
    size: int


@dataclass(frozen=True)
class Model:
    """target and features, each feature a column and its lag in units of time. plain: columns without seasonal parts."""

    target: str
    features: tuple[tuple[str, int], ...]
    bins: tuple[Bin, ...]
    period: Callable[[Column], Column]
    unit: str = "1 hour"
    alpha: float = 1.0
    plain: tuple[str, ...] = ()
    least: int = 30
    columns: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(dict.fromkeys([self.target, *(c for c, _ in self.features)])))

    @property
    def now(self) -> list[tuple[str, int]]:
        """Variables of a row's own time: the features, then the target."""
        return [*self.features, (self.target, 0)]

    @property
    def variables(self) -> list[tuple[str, int]]:
        """The same, and all of them one unit before, for the memory of errors."""
        return list(dict.fromkeys([*self.now, *((c, lag + 1) for c, lag in self.now)]))

    @property
    def lags(self) -> list[int]:
        return sorted({lag for _, lag in self.variables})

    def at(self, lag: int) -> Column:
        return F.col("ts") - lag * F.expr(f"interval {self.unit}")

    def slots(self) -> list[tuple[int, int]]:
        return [(lag, k) for lag in self.lags for k in range(len(self.bins))]


def lagged(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """keys, ts and a column <name>__<lag> for each variable, for every ts that rows have; one exchange for all lags.

    Lags go by time: where the earlier row is missing the value is null. Of rows with the same keys and ts the greatest values count. Rows
    with a null ts are left out.
    """
    dealt = rows.filter(F.col("ts").isNotNull()).select(*keys, *model.columns, "ts", F.explode(F.array(*map(F.lit, model.lags))).alias("lag"))
    dealt = dealt.withColumn("ts", F.col("ts") + F.col("lag") * F.expr(f"interval {model.unit}"))
    pick = [F.max(F.when(F.col("lag") == lag, F.col(c).cast("double"))).alias(f"{c}__{lag}") for c, lag in dict.fromkeys([*model.variables, *((c, 0) for c in model.columns)])]
    there = F.max(F.when(F.col("lag") == 0, True)).alias("there")
    return dealt.groupBy(*keys, "ts").agg(there, *pick).filter("there").drop("there")


def statistics(wide: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """keys, period and the entries (kind, i, j, a, b, v) of all sums that the models need.

    s: sum of column i in place a of bin j; p: rows of column i in place a of bin j // bins and b of bin j % bins; g: product of variables i and j
    (i = -1: the constant); x: sum of variable i in place a of slot j; q: rows in place a of slot i and b of slot j. s and p are over all rows of a
    column, the others over rows that have all variables.
    """
    bins, slots, variables = model.bins, model.slots(), model.variables
    place = {s: bins[s[1]].of(model.at(s[0])).cast("int") for s in slots}
    value = lambda v: F.col(f"{v[0]}__{v[1]}")
    whole = F.lit(True)
    for v in variables:
        whole = whole & value(v).isNotNull()
    nothing = F.lit(-1)

    def entry(kind: str, i: int, j: int, a: Column, b: Column, v: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), F.lit(j).alias("j"), a.alias("a"), b.alias("b"), v.alias("v")))

    entries = []
    for i, c in enumerate(model.columns):
        own = value((c, 0))
        for j in range(len(bins)):
            entries.append(entry("s", i, j, place[0, j], nothing, own, own.isNotNull()))
            entries += [entry("p", i, j * len(bins) + k, place[0, j], place[0, k], F.lit(1.0), own.isNotNull()) for k in range(j + 1)]
    for i, v in enumerate(variables):
        entries.append(entry("g", -1, i, nothing, nothing, value(v), whole))
        entries += [entry("g", i, j, nothing, nothing, value(v) * value(w), whole) for j, w in enumerate(variables) if j >= i]
        entries += [entry("x", i, j, place[s], nothing, value(v), whole) for j, s in enumerate(slots)]
    entries += [entry("q", i, j, place[s], place[t], F.lit(1.0), whole) for i, s in enumerate(slots) for j, t in enumerate(slots) if j >= i]
    told = wide.select(*keys, model.period(F.col("ts")).cast("timestamp").alias("period"), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
    return told.select(*keys, "period", "e.*").groupBy(*keys, "period", "kind", "i", "j", "a", "b").agg(F.sum("v").alias("v"))


class _Sums:
    """Statistics added up so far, and the model they give."""

    def __init__(self, model: Model):
        self.model, size = model, [b.size for b in model.bins]
        self.slots, n = model.slots(), len(model.bins)
        self.s = {(i, j): np.zeros(size[j]) for i in range(len(model.columns)) for j in range(n)}
        self.p = {(i, j * n + k): np.zeros((size[j], size[k])) for i in range(len(model.columns)) for j in range(n) for k in range(j + 1)}
        m = len(model.variables)
        self.g = np.zeros((m + 1, m + 1))
        self.n = 0
        self.x = {(i, j): np.zeros(size[s[1]]) for i in range(m) for j, s in enumerate(self.slots)}
        self.q = {(i, j): np.zeros((size[s[1]], size[t[1]])) for i, s in enumerate(self.slots) for j, t in enumerate(self.slots) if j >= i}

    def add(self, told: pd.DataFrame) -> None:
        for (kind, i, j), e in told.groupby(["kind", "i", "j"], sort=False):
            a, b, v = e["a"].to_numpy(), e["b"].to_numpy(), e["v"].to_numpy()
            if kind == "g":
                self.g[i + 1, j + 1] += v.sum()
                self.g[j + 1, i + 1] = self.g[i + 1, j + 1]
            elif kind in "sx":
                np.add.at(self.s[i, j] if kind == "s" else self.x[i, j], a, v)
            else:
                np.add.at(self.p[i, j] if kind == "p" else self.q[i, j], (a, b), v)

    def parts(self, column: str) -> list[np.ndarray]:
        """A column's seasonal parts: a place's mean of what the parts before leave; 0 for a place without rows."""
        i, n, found = self.model.columns.index(column), len(self.model.bins), []
        for j in range(n):
            if column in self.model.plain:
                found.append(np.zeros(self.model.bins[j].size))
                continue
            rows = np.diag(self.p[i, j * n + j])
            left = self.s[i, j] - sum((self.p[i, j * n + k] @ found[k] for k in range(j)), 0.0)
            found.append(np.divide(left, rows, out=np.zeros(len(rows)), where=rows > 0))
        return found

    def remainders(self, parts: dict[str, list[np.ndarray]]) -> np.ndarray:
        """Sums of products of the constant and all variables' remainders."""
        variables, at = self.model.variables, {s: j for j, s in enumerate(self.slots)}
        season = [[(at[lag, k], parts[c][k]) for k in range(len(self.model.bins))] for c, lag in variables]
        pair = lambda i, j: self.q[i, j] if j >= i else self.q[j, i].T
        out = self.g.copy()
        out[0, 0] = self.q[0, 0].trace()
        for j, own in enumerate(season):
            out[0, j + 1] -= sum(m @ np.diag(pair(slot, slot)) for slot, m in own)
            out[j + 1, 0] = out[0, j + 1]
        for i, one in enumerate(season):
            for j, two in enumerate(season):
                both = sum(m @ pair(s, t) @ w for s, m in one for t, w in two)
                out[i + 1, j + 1] += both - sum(w @ self.x[i, t] for t, w in two) - sum(m @ self.x[j, s] for s, m in one)
        return out

    def solve(self) -> tuple | None:
        """n, intercept, coefficients, phi and parts; None with fewer rows than ``least``."""
        model = self.model
        n = int(round(self.q[0, 0].trace()))
        if n < model.least:
            return None
        parts = {c: self.parts(c) for c in model.columns}
        sums, at = self.remainders(parts), {v: i + 1 for i, v in enumerate(model.variables)}
        b = ridge_of(sums, [at[f] for f in model.features], at[model.target, 0], model.alpha)
        now, before = np.zeros(len(sums)), np.zeros(len(sums))
        for error, shift in ((now, 0), (before, 1)):
            error[0] = -b[0]
            error[at[model.target, shift]] += 1
            for (c, lag), x in zip(model.features, b[1:], strict=True):
                error[at[c, lag + shift]] -= x
        size = before @ sums @ before
        phi = float(np.clip(now @ sums @ before / size, -0.99, 0.99)) if size > 1e-12 else 0.0
        return n, float(b[0]), b[1:].tolist(), phi, [p.tolist() for c in model.columns for p in parts[c]]


def models(stats: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """keys, period, n, intercept, coef, phi, parts: for each period that a key has rows in, the model of all rows before it. Periods with
    fewer than ``least`` whole rows before them have none."""
    schema = StructType([*stats.select(*keys).schema.fields, *StructType.fromDDL(MODEL).fields])
    # what tasks need: sizes and names, no columns
    bare = replace(model, bins=tuple(Bin(None, b.size) for b in model.bins), period=None)

    def solve(name: tuple, told: pd.DataFrame) -> pd.DataFrame:
        sums, out = _Sums(bare), []
        for period, own in told.sort_values(["period", "kind", "i", "j", "a", "b"]).groupby("period", sort=True):
            found = sums.solve()
            if found:
                out.append((*name, period, *found))
            sums.add(own)
        return pd.DataFrame(out, columns=schema.names)

    if keys:
        return stats.groupBy(*keys).applyInPandas(solve, schema)
    return stats.groupBy(F.lit(0).alias("all")).applyInPandas(lambda told: solve((), told), schema)


def _season(model: Model, column: str, lag: int) -> Column:
    first, n = model.columns.index(column) * len(model.bins), len(model.bins)
    return sum((F.get(F.get("parts", F.lit(first + k)), b.of(model.at(lag)).cast("int")) for k, b in zip(range(n), model.bins, strict=True)), F.lit(0.0))


def applied(rows: DataFrame, model: Model, lead: Column | None = None, zeroed: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """rows (the lagged columns and a model's) with season and linear in place of the model's parts and coefficients.

    A feature that is null counts as its season, and so does one of ``zeroed`` and, with a lead (in units), one that isn't known so long
    before: its lag is shorter than the lead.
    """
    linear = F.col("intercept")
    for i, (c, lag) in enumerate(model.features):
        left = F.coalesce(F.col(f"{c}__{lag}") - _season(model, c, lag), F.lit(0.0))
        if lead is not None:
            left = F.when(lead <= lag, left).otherwise(0.0)
        linear = linear + F.get("coef", F.lit(i)) * (F.lit(0.0) if (c, lag) in zeroed else left)
    return rows.withColumns({"season": _season(model, model.target, 0), "linear": linear}).drop("parts", "coef", "intercept")


def walk_forward(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """keys, ts, actual, period, n, season, linear, phi: every row by the model of all rows before its period.

    rows: keys, ts, target and feature columns. Rows of periods without a model, and of null keys, are left out; an empty table gives none.
    """
    wide = settled(lagged(rows, keys, model))
    found = models(statistics(wide, keys, model), keys, model)
    joined = wide.withColumn("period", model.period(F.col("ts")).cast("timestamp")).join(found, [*keys, "period"])
    return applied(joined, model).select(*keys, "ts", F.col(f"{model.target}__0").alias("actual"), "period", "n", "season", "linear", "phi")


def replay(rows: DataFrame, keys: list[str], model: Model, frozen: Column, zeroed: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """keys, ts, actual, season, linear: all rows from ``frozen`` (a timestamp) on by the one model of the rows before it. zeroed: features
    that the application doesn't feed."""
    wide = lagged(rows, keys, model)
    past = replace(model, period=lambda ts: F.when(ts < frozen, F.lit("1970-01-01").cast("timestamp")).otherwise(frozen))
    found = models(statistics(wide, keys, past), keys, past).filter(F.col("period") == frozen).drop("period")
    later = wide.filter(F.col("ts") >= frozen)
    joined = later.join(found, keys) if keys else later.crossJoin(F.broadcast(found))  # without keys it is one row
    return applied(joined, model, zeroed=zeroed).select(*keys, "ts", F.col(f"{model.target}__0").alias("actual"), "season", "linear")


def horizon(rows: DataFrame, keys: list[str], model: Model, origins: Column, leads: list[int]) -> DataFrame:
    """keys, origin, lead, ts, actual, pred: forecasts made at each origin for each lead (in units), with what is known there.

    origins: a condition on ts. The model is that of the origin's period; a feature whose lag is shorter than the lead counts as its season; the
    error at the origin fades with phi ** lead (0 where the origin's actual is null). Targets without a row are left out.
    """
    wide = settled(lagged(rows, keys, model))
    found = settled(models(statistics(wide, keys, model), keys, model))
    periods = wide.withColumn("period", model.period(F.col("ts")).cast("timestamp"))
    start = applied(periods.filter(origins).join(found, [*keys, "period"]), model)
    error = F.coalesce(F.col(f"{model.target}__0") - F.col("season") - F.col("linear"), F.lit(0.0)).alias("error")
    asked = start.select(*keys, "period", F.col("ts").alias("origin"), error, F.explode(F.array(*map(F.lit, leads))).alias("lead"))
    asked = asked.withColumn("ts", F.col("origin") + F.col("lead") * F.expr(f"interval {model.unit}"))
    ahead = asked.join(wide, [*keys, "ts"]).join(found, [*keys, "period"])
    out = applied(ahead, model, F.col("lead"))
    pred = F.col("season") + F.col("linear") + F.pow("phi", "lead") * F.col("error")
    return out.select(*keys, "origin", "lead", "ts", F.col(f"{model.target}__0").alias("actual"), pred.alias("pred"))
