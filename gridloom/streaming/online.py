"""Online learners: one step serves the batch walk and the stream, so both give the same state.

A batch walk deals rows by key, sorts each partition by key and time, and goes through it row by row. What a task holds is one key's
state, however long its series; a key is one ordered walk, and different keys go side by side.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BIAS = "bias double, spread double, n long"
# Learning rates of the interval experts.
RATES = [0.0005, 0.001, 0.002, 0.003, 0.005, 0.008, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2]
CONFORMAL = "levels array<double>, losses array<double>, scores array<double>, n long, bias double, spread double, seen long"


def ordered_walk(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable, step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """keys and what ``step(state, order and values)`` gives for each row in order, or ``finish(state)`` for each key at its end.

    start makes a key's state, which step may change; a step that gives None makes no row. schema: of what comes behind the keys.
    An empty table gives an empty table.
    """
    used = rows.select(*keys, *order, *values)
    out = StructType([*used.select(*keys).schema.fields, *StructType.fromDDL(schema).fields])
    arrow, width = to_arrow_schema(out), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            told = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = row[:width]
                if state is None or key != now:
                    if state is not None and finish:
                        told.append((*now, *finish(state)))
                    now, state = key, start()
                got = step(state, *row[width:])
                if got is not None and not finish:
                    told.append((*key, *got))
            yield _batch(told, arrow)
        if state is not None and finish:
            yield _batch([(*now, *finish(state))], arrow)

    return used.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def bias_step(state: tuple[float, float, int], error: float, weight: float, limit: float = 5.0, least: int = 3) -> tuple[float, float, int]:
    """Next (bias, mean absolute error, count): errors beyond ``limit`` mean absolute errors are held there; the first ones
    count as a plain mean until an exponential one would weigh them less."""
    bias, spread, n = state
    if n >= least and spread > 0:
        error = max(min(error, limit * spread), -limit * spread)
    w = max(1.0 / (n + 1), weight)
    return (1 - w) * bias + w * error, (1 - w) * spread + w * abs(error), n + 1


def half_life_weight(days: float, a_day: int) -> float:
    return 1 - 0.5 ** (1 / max(1.0, days * a_day))


class Bias:
    """A running bias; it corrects once ``warm`` errors are known, and passes over errors that are null."""

    def __init__(self, weight: float, warm: int = 0, state: tuple[float, float, int] = (0.0, 0.0, 0)):
        self.weight, self.warm, self.state = weight, warm, state

    def correct(self, forecast: float) -> float:
        return forecast + self.state[0] if self.state[2] >= self.warm else forecast

    def learn(self, forecast: float | None, actual: float | None) -> None:
        if forecast is not None and actual is not None:
            self.state = bias_step(self.state, actual - forecast, self.weight)


def bias_fold(rows: DataFrame, keys: list[str], days: float = 3.0, a_day: int = 1, seeds: tuple[float, float, int] = (0.0, 0.0, 0)) -> DataFrame:
    """keys, bias, spread, n after all rows (ts, actual, pred) of a key in order of ts. seeds: the state to start from."""
    w = half_life_weight(days, a_day)
    return ordered_walk(rows, keys, ["ts"], ["actual", "pred"], lambda: Bias(w, state=seeds), lambda s, _, actual, pred: s.learn(pred, actual), BIAS, lambda s: s.state)


def bias_walk(rows: DataFrame, keys: list[str], days: float = 3.0, a_day: int = 1, warm: int = 3) -> DataFrame:
    """keys, ts, corrected, bias: each row's forecast corrected by what was learned before it, then learned from."""
    w = half_life_weight(days, a_day)

    def step(state: Bias, ts, actual, pred):
        corrected, bias = None if pred is None else state.correct(pred), state.state[0]
        state.learn(pred, actual)
        return ts, corrected, bias

    return ordered_walk(rows, keys, ["ts"], ["actual", "pred"], lambda: Bias(w, warm), step, "ts timestamp, corrected double, bias double")


def _known(value) -> float | None:
    """A cell of a pandas row: what Spark has as null comes as NaN or None."""
    return None if pd.isna(value) else float(value)


def bias_stream(rows: DataFrame, key: str, days: float = 3.0, a_day: int = 1) -> DataFrame:
    """The same as a stream (update mode): key, bias, spread, n after each batch's rows of a key, taken in order of ts.

    Rows with a null forecast or actual teach nothing, as in the walk. A row that comes in a later batch than rows behind it is learned then.
    """
    w = half_life_weight(days, a_day)

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = Bias(w, state=tuple(state.get) if state.exists else (0.0, 0.0, 0))
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            now.learn(_known(row.pred), _known(row.actual))
        state.update(now.state)
        yield pd.DataFrame([(*name, *now.state)], columns=[key, "bias", "spread", "n"])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {BIAS}", BIAS, "update", "NoTimeout")


class Conformal:
    """Intervals at a level that experts adapt: each moves its own level at its own rate by whether the last interval missed, and their
    discounted misses weigh them. The scores of the last ``window`` rows are held sorted as well, so that a quantile is one look."""

    def __init__(self, target: float = 0.9, window: int = 720, warm: int = 24, eta: float = 5.0, decay: float = 0.99, rates: list[float] = RATES, bias: Bias | None = None):
        self.miss, self.window, self.warm, self.eta, self.decay, self.rates, self.bias = 1 - target, window, warm, eta, decay, rates, bias
        self.levels, self.losses, self.scores, self.sorted, self.n = [1 - target] * len(rates), [0.0] * len(rates), deque(), [], 0

    def quantile(self, level: float) -> float:
        """Between the two scores next to a level; 0 without any."""
        if not self.sorted:
            return 0.0
        at = min(max(level, 0.0), 1.0) * (len(self.sorted) - 1)
        low = min(int(at), len(self.sorted) - 1)
        return self.sorted[low] + (self.sorted[min(low + 1, len(self.sorted) - 1)] - self.sorted[low]) * (at - low)

    def weights(self) -> list[float]:
        least = min(self.losses)
        each = [math.exp(-self.eta * (x - least)) for x in self.losses]
        return [x / sum(each) for x in each]

    def level(self) -> float:
        return max(1e-6, min(1 - 1e-6, sum(w * a for w, a in zip(self.weights(), self.levels))))

    def half_width(self) -> float:
        return self.quantile(1 - self.level()) if self.n >= self.warm else 0.0

    def predict(self, forecast: float) -> tuple[float, float, float]:
        point, half = self.bias.correct(forecast) if self.bias else forecast, self.half_width()
        return point - half, point, point + half

    def learn(self, forecast: float, actual: float) -> None:
        score = abs(actual - (self.bias.correct(forecast) if self.bias else forecast))
        if self.bias:
            self.bias.learn(forecast, actual)
        for k, rate in enumerate(self.rates):
            miss = float(score > self.quantile(1 - self.levels[k]))
            self.levels[k] = max(1e-6, min(1 - 1e-6, self.levels[k] + rate * (self.miss - miss)))
            self.losses[k] = self.decay * self.losses[k] + miss
        self._keep(score)
        self.n += 1

    def _keep(self, score: float) -> None:
        self.scores.append(score)
        insort(self.sorted, score)
        if len(self.scores) > self.window:
            del self.sorted[bisect_left(self.sorted, self.scores.popleft())]

    def held(self) -> tuple:
        """The state as plain values, for CONFORMAL."""
        return self.levels, self.losses, list(self.scores), self.n, *(self.bias.state if self.bias else (0.0, 0.0, 0))

    def restore(self, held: tuple) -> Conformal:
        self.levels, self.losses, self.n = list(held[0]), list(held[1]), held[3]
        self.scores, self.sorted = deque(held[2]), sorted(held[2])
        if self.bias:
            self.bias.state = tuple(held[4:7])
        return self


def entropy_bits(weights: list[float]) -> float:
    """How undecided the experts are: 0 where one has all the weight."""
    return -sum(w * math.log2(w) for w in weights if w > 1e-12)


def _with_bias(days: float | None, a_day: int) -> Bias | None:
    return None if days is None else Bias(half_life_weight(days, a_day), 3)


def conformal_intervals(rows: DataFrame, key: str | list[str], target: float = 0.9, window: int = 720, warm: int = 24, rates: list[float] = RATES, bias_days: float | None = None, a_day: int = 24) -> DataFrame:
    """keys, ts, lower, upper, hit: intervals around pred (corrected by a running bias, with bias_days) from the errors before it.

    A row without pred has none, and one without actual neither hits nor teaches.
    """

    def step(state: Conformal, ts, actual, pred):
        if pred is None:
            return None
        lower, _, upper = state.predict(pred)
        if actual is None:
            return ts, lower, upper, None
        state.learn(pred, actual)
        return ts, lower, upper, lower <= actual <= upper

    keys = [key] if isinstance(key, str) else key
    start = lambda: Conformal(target, window, warm, rates=rates, bias=_with_bias(bias_days, a_day))
    return ordered_walk(rows, keys, ["ts"], ["actual", "pred"], start, step, "ts timestamp, lower double, upper double, hit boolean")


def conformal_state(rows: DataFrame, keys: list[str], target: float = 0.9, window: int = 720, warm: int = 24, rates: list[float] = RATES) -> DataFrame:
    """keys, n, warmed, coverage (one less the level that holds now), half_width, entropy (bits) after all rows of a key."""
    def step(state: Conformal, _, actual, pred):
        if actual is not None and pred is not None:
            state.learn(pred, actual)

    finish = lambda s: (s.n, s.n >= s.warm, 1 - s.level(), s.half_width(), entropy_bits(s.weights()))
    return ordered_walk(rows, keys, ["ts"], ["actual", "pred"], lambda: Conformal(target, window, warm, rates=rates), step, "n long, warmed boolean, coverage double, half_width double, entropy double", finish)


def conformal_stream(rows: DataFrame, key: str, target: float = 0.9, window: int = 720, warm: int = 24, bias_days: float | None = None, a_day: int = 24) -> DataFrame:
    """The same as a stream (append mode): key, ts, lower, upper, hit of each batch's rows of a key, taken in order of ts.

    A row without pred has no interval, and one without actual neither hits nor teaches, as in the walk. A row that comes in a later
    batch than rows behind it is learned then.
    """

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, out = Conformal(target, window, warm, bias=_with_bias(bias_days, a_day)), []
        if state.exists:
            now.restore(tuple(state.get))
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            pred, actual = _known(row.pred), _known(row.actual)
            if pred is None:
                continue
            lower, _, upper = now.predict(pred)
            if actual is not None:
                now.learn(pred, actual)
            out.append((*name, row.ts, lower, upper, None if actual is None else lower <= actual <= upper))
        state.update(now.held())
        told = pd.DataFrame(out, columns=[key, "ts", "lower", "upper", "hit"])
        yield told.astype({"hit": "boolean"})

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ts timestamp, lower double, upper double, hit boolean", CONFORMAL, "append", "NoTimeout")


def smoothed(rows: DataFrame, keys: list[str], value: str, weight: float) -> DataFrame:
    """keys, ts, smooth, n: an exponential mean that starts at the first value; a null keeps the one before."""

    def step(state: dict, ts, x):
        if x is not None:
            state["v"], state["n"] = x if state["v"] is None else (1 - weight) * state["v"] + weight * x, state["n"] + 1
        return ts, state["v"], state["n"]

    return ordered_walk(rows, keys, ["ts"], [value], lambda: {"v": None, "n": 0}, step, "ts timestamp, smooth double, n long")


def refit_alarms(rows: DataFrame, keys: list[str], coverage: str, target: float = 0.9, drift: float = 0.05, steps: int = 336) -> DataFrame:
    """keys, start, since, alarm: runs of at least ``steps`` rows whose coverage is more than ``drift`` off target; alarm is when the run gets so long."""
    from gridloom.operators.series import episodes

    off = F.abs(F.col(coverage) - target) > drift
    return episodes(rows, keys, off, steps, at=steps).select(*keys, "start", "hours", F.col("at").alias("alarm"))
