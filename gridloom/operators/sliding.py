"""Quantiles over sliding windows: a sorted window with one insert and one removal a row, instead of a percentile that reads its frame anew."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gridloom.names import fresh_name
from gridloom.streaming.online import ordered_walk


def between(held: list[float], level: float) -> float | None:
    """The value at a level of sorted values, between the two next to it; None without any."""
    if not held:
        return None
    at = level * (len(held) - 1)
    low = int(at)
    return held[low] + (held[min(low + 1, len(held) - 1)] - held[low]) * (at - low)


def by_hours(rows: DataFrame, keys: list[str], value: str, hours: int, levels: dict[str, float], least: int = 1, chunk_hours: int | None = None) -> DataFrame:
    """keys, ts, n and a column for each level: quantiles of the values of the last ``hours`` hours up to each row, rows of the same ts
    included; null with fewer than ``least`` of them. n: how many there are.

    A key is cut into stretches of ``chunk_hours`` (by default four windows), each with a copy of a window's length before it; a task holds one
    stretch. Null values are in no window but have rows; rows without a ts are left out.
    """
    size = 3600 * (chunk_hours or 4 * hours)
    chunk, second, copied = fresh_name(rows, "chunk", "second", "copied")
    known = rows.filter(F.col("ts").isNotNull()).select(*keys, "ts", F.col(value).cast("double").alias(value), F.unix_timestamp("ts").alias(second))
    own = F.floor(F.col(second) / size)
    dealt = known.withColumn(chunk, F.explode(F.sequence(own, F.floor((F.col(second) + hours * 3600 - 1) / size)))).withColumn(copied, F.col(chunk) > own)
    named = [*dealt.select(*keys, "ts").schema.fields]
    schema = StructType([*named, StructField("n", LongType()), *(StructField(name, DoubleType()) for name in levels)])

    def slide(stretch: pd.DataFrame) -> pd.DataFrame:
        stretch = stretch.sort_values(second, kind="stable")
        at, x = stretch[second].to_numpy(), stretch[value].to_numpy(float)
        held: list[float] = []
        out, first, done = np.full((len(at), 1 + len(levels)), np.nan), 0, 0
        while done < len(at):
            last = int(np.searchsorted(at, at[done], side="right"))
            for v in x[done:last][~np.isnan(x[done:last])].tolist():
                insort(held, v)
            while at[first] <= at[done] - hours * 3600:
                if x[first] == x[first]:
                    del held[bisect_left(held, x[first])]
                first += 1
            out[done:last, 0] = len(held)
            if len(held) >= max(least, 1):
                out[done:last, 1:] = [between(held, q) for q in levels.values()]
            done = last
        told = stretch[[f.name for f in named]].assign(n=out[:, 0].astype(np.int64), **{name: out[:, 1 + i] for i, name in enumerate(levels)})
        told = told[~stretch[copied].to_numpy(bool)]
        return told.astype({name: object for name in levels}).where(told.notna(), None)

    return dealt.groupBy(*keys, chunk).applyInPandas(slide, schema)


def by_rows(rows: DataFrame, keys: list[str], value: str, window: int, level: float) -> DataFrame:
    """keys, ts, n, level_value: the quantile of the values of the ``window`` rows before each row, and how many of these have one.

    An ordered walk that holds a window of one key. Rows with the same keys and ts stand in any order.
    """

    def step(state: dict, ts, x):
        told = ts, len(state["sorted"]), between(state["sorted"], level)
        state["last"].append(x)
        if x is not None:
            insort(state["sorted"], x)
        if len(state["last"]) > window:
            old = state["last"].popleft()
            if old is not None:
                del state["sorted"][bisect_left(state["sorted"], old)]
        return told

    return ordered_walk(rows.withColumn(value, F.col(value).cast("double")), keys, ["ts"], [value], lambda: {"last": deque(), "sorted": []}, step, "ts timestamp, n long, level_value double")
