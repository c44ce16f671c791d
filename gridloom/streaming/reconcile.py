"""Forecasts meet their actuals: one step feeds a region's calibrators, in a batch walk and in a stream with state and timers.

Rows are tellings: (keys, told, kind, ts, value, model), kind ``forecast`` or ``actual``, ts the hour that they are about (both times in
seconds), model the fingerprint of the model that made a forecast. They are taken in order of told, then kind, ts, value:

- a forecast for an hour that is still ahead waits for its actual; a later one for the same hour takes its place;
- an actual meets the forecast that waits for its hour, once: the pair gives a row and is learned. Later tellings of that hour do nothing;
- a forecast waits 14 days behind its hour;
- calibrators belong to a model: the first pair of another one starts them anew.

The stream holds tellings back until the watermark on told has passed them, so what it gives doesn't depend on how rows come in batches, as
long as none comes later than the watermark's delay. Rows with a null among told, kind, ts and value do nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from gridloom.streaming.online import Bias, Conformal, half_life_weight, ordered_walk

WAIT = 14 * 86_400
HOUR, DAY = 3600, 86_400
TOLD = "ts long, told long, forecast double, corrected double, lower double, upper double, actual double, bias double, n long, model string"
#: A region's learned state as plain values.
LEARNED = "model string, bias array<double>, spread array<double>, n array<long>, levels array<double>, losses array<double>, scores array<double>, seen long"
LEARNED_NAMES = [c.split()[0] for c in LEARNED.split(", ")]
TELLING = ["told", "kind", "ts", "value", "model"]


class Calibrators:
    """A bias for each hour of the day, and an interval around what it corrects."""

    def __init__(self, days: float = 14.0, warm: int = 3, target: float = 0.9, window: int = 720, interval_warm: int = 24):
        self.made = (days, warm, target, window, interval_warm)
        self.renew(None)

    def renew(self, model: str | None) -> None:
        days, warm, target, window, interval_warm = self.made
        self.model = model
        self.hours = [Bias(half_life_weight(days, 1), warm) for _ in range(24)]
        self.interval = Conformal(target, window, interval_warm)

    def pair(self, ts: int, told: int, forecast: float, actual: float, model: str | None) -> tuple:
        """The row of a pair, by what was learned before it; then learns from it."""
        if self.interval.n and model != self.model:
            self.renew(model)
        self.model = model
        bias = self.hours[ts // HOUR % 24]
        corrected = bias.correct(forecast)
        lower, _, upper = self.interval.predict(corrected)
        out = (ts, told, forecast, corrected, lower, upper, actual, bias.state[0], bias.state[2], model)
        bias.learn(forecast, actual)
        self.interval.learn(corrected, actual)
        return out

    def held(self) -> tuple:
        """The state, for LEARNED."""
        states = [b.state for b in self.hours]
        return self.model, *([s[i] for s in states] for i in range(3)), *self.interval.held()[:4]

    def restore(self, held: tuple) -> Calibrators:
        self.model = held[0]
        for bias, *state in zip(self.hours, *held[1:4], strict=True):
            bias.state = tuple(state)
        self.interval.restore(tuple(held[4:8]))
        return self


def take(calibrators: Calibrators, waiting: MutableMapping, told: int, kind: str, ts: int, value: float, model: str | None, wait: int = WAIT) -> tuple | None:
    """One telling. waiting: from hours to (forecast, model) that wait, or (None, None) where the pair was made."""
    now = waiting.get(ts)
    met = now is not None and now[0] is None
    if kind == "forecast" and ts > told and not met:
        waiting[ts] = (value, model)
    if kind == "actual" and now is not None and not met and told - ts <= wait:
        waiting[ts] = (None, None)
        return calibrators.pair(ts, told, now[0], value, now[1])
    return None


def _seeded(make: Callable[[], Calibrators], seed: tuple | None) -> Calibrators:
    return make().restore(seed) if seed is not None else make()


def reconciled_walk(rows: DataFrame, keys: list[str], seeds: DataFrame | None = None, make: Callable[[], Calibrators] = Calibrators, wait: int = WAIT) -> DataFrame:
    """keys and TOLD: a row for each pair, in order of told. seeds: keys and LEARNED, the state that a key starts from (a row a key)."""

    def step(state: dict, told, kind, ts, value, model, *seed):
        if kind == "":  # a key's seed comes before its tellings
            state["calibrators"] = _seeded(make, seed)
            return None
        if told >= state["pruned"] + DAY:
            state["pruned"] = told
            for ts_ in [t for t in state["waiting"] if told - t > wait]:
                del state["waiting"][ts_]
        return take(state["calibrators"], state["waiting"], told, kind, ts, value, model, wait)

    names = LEARNED_NAMES[1:]
    known = rows.select(*keys, *TELLING).dropna(subset=TELLING[:-1]).withColumn("value", F.col("value").cast("double"))
    empty = StructType.fromDDL(LEARNED)
    known = known.withColumns({f"seed_{n}": F.lit(None).cast(empty[n].dataType) for n in names})
    if seeds is not None:
        first = seeds.select(*keys, F.lit(-(2**62)).alias("told"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("ts"), F.lit(0.0).alias("value"), "model", *[F.col(n).alias(f"seed_{n}") for n in names])
        known = known.unionByName(first)
    walked = ordered_walk(known, keys, ["told", "kind", "ts", "value"], ["model", *[f"seed_{n}" for n in names]], lambda: {"calibrators": make(), "waiting": {}, "pruned": 0}, lambda s, told, kind, ts, value, model, *seed: step(s, told, kind, ts, value, model, model, *seed), TOLD)
    return walked


class _Waiting(MutableMapping):
    """The waiting forecasts as a map state."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, ts):
        if not self.state.containsKey((ts,)):
            raise KeyError(ts)
        value, model = self.state.getValue((ts,))
        return value, model

    def __setitem__(self, ts, told):
        self.state.updateValue((ts,), told)

    def __delitem__(self, ts):
        self.state.removeKey((ts,))

    def __iter__(self):
        return iter([k[0] for k in self.state.keys()])

    def __len__(self):
        return sum(1 for _ in self.state.keys())


class _Reconciler(StatefulProcessor):
    """Holds tellings until the watermark has passed them, and forecasts until their actual or their time is up."""

    def __init__(self, names: list[str], make: Callable[[], Calibrators], wait: int):
        self.names, self.make, self.wait = names, make, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.inbox = handle.getListState("inbox", "told long, kind string, ts long, value double, model string")
        self.learned = handle.getValueState("learned", LEARNED)
        self.waiting = handle.getMapState("waiting", "ts long", "value double, model string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.learned.update(tuple(initialState[n] for n in LEARNED_NAMES))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in TELLING) for r in rows]
        new = [r for r in new if None not in r[:-1]]
        if new:
            self.inbox.appendList(new)
        for told in {r[0] for r in new}:
            self.handle.registerTimer((told + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        held = [tuple(r) for r in self.inbox.get()] if self.inbox.exists() else []
        due = sorted((r for r in held if r[0] < passed), key=lambda r: (*r[:4], r[4] is not None, r[4] or ""))
        waiting = _Waiting(self.waiting)
        if due:
            later = [r for r in held if r[0] >= passed]
            self.inbox.put(later) if later else self.inbox.clear()
            calibrators = _seeded(self.make, tuple(self.learned.get()) if self.learned.exists() else None)
            for told, kind, ts, value, model in due:
                row = take(calibrators, waiting, told, kind, ts, value, model, self.wait)
                if kind == "forecast" and ts > told:
                    self.handle.registerTimer((ts + self.wait + 1) * 1000)
                if row:
                    yield Row(**dict(zip(self.names, (*key, *row), strict=True)))
            self.learned.update(calibrators.held())
        for ts in [t for t in waiting if passed - t > self.wait]:
            del waiting[ts]

    def close(self) -> None:
        pass


def reconciled_stream(rows: DataFrame, keys: list[str], delay: str, seeds: DataFrame | None = None, make: Callable[[], Calibrators] = Calibrators, wait: int = WAIT) -> DataFrame:
    """The same as a stream (append mode). rows: a stream with ``at``, told as a timestamp, besides; delay: how late a telling may come.

    seeds: a batch table as above, read when the stream first starts. The session needs RocksDB's state store
    (spark.sql.streaming.stateStore.providerClass). A restart goes on from the checkpoint.
    """
    marked = rows.withWatermark("at", delay).select(*keys, "at", "told", "kind", "ts", F.col("value").cast("double").alias("value"), "model")
    schema = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL(TOLD).fields])
    start = seeds.groupBy(*keys) if seeds is not None else None
    return marked.groupBy(*keys).transformWithState(_Reconciler(schema.names, make, wait), schema, "Append", "EventTime", start)


def learned_walk(rows: DataFrame, keys: list[str], seeds: DataFrame | None = None, make: Callable[[], Calibrators] = Calibrators) -> DataFrame:
    """keys and LEARNED: the calibrators after all pairs (keys, TOLD) of a key, to be written and to start a stream from."""

    def learn(state: list, told, ts, forecast, actual, model, *seed):
        if seed[-1] is not None:
            state[0].restore((model, *seed))
        else:
            state[0].pair(ts, told, forecast, actual, model)

    names = StructType.fromDDL(LEARNED)
    fields = names.names[1:]
    used = rows.select(*keys, "told", "ts", "forecast", "actual", "model").withColumns({f"seed_{n}": F.lit(None).cast(names[n].dataType) for n in fields})
    if seeds is not None:
        nothing = {c: F.lit(0.0).alias(c) for c in ("forecast", "actual")}
        used = used.unionByName(seeds.select(*keys, F.lit(-(2**62)).alias("told"), F.lit(0).cast("long").alias("ts"), *nothing.values(), "model", *[F.col(n).alias(f"seed_{n}") for n in fields]))
    return ordered_walk(used, keys, ["told", "ts"], ["forecast", "actual", "model", *[f"seed_{n}" for n in fields]], lambda: [make()], learn, LEARNED, lambda s: s[0].held())
