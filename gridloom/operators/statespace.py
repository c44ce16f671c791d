"""ARMA(2, 1) with inputs by exact likelihood: a Kalman filter whose steps are combined block by block, so that one series isn't one task.

The filter's steps form a semigroup (Särkkä and García-Fernández, 2021): what a stretch of steps does to the state's mean and covariance is an
element of two-by-two matrices, and elements of neighbouring stretches combine. A pass makes one element a block; the driver goes through them in order (a
row a block) and so knows the state at each block's start; a second pass filters each block from there. Missing hours are steps without
an observation. The value and its inputs are filtered side by side, so inputs' coefficients and the variance are best for given ar1, ar2, ma1 without
a search, and many such points are filtered in one pass.
"""

from __future__ import annotations

import pickle
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import settled

#: Hours of a block.
BLOCK = 512
I2 = np.eye(2)


def stationary(points: np.ndarray) -> np.ndarray:
    """Which points (ar1, ar2, ma1) have a law that stays, and shocks that the past tells."""
    a, b, m = points.T
    return (np.abs(b) < 0.999) & (a + b < 0.999) & (b - a < 0.999) & (np.abs(m) < 0.999)


class Filters:
    """The filters of several points at once; arrays begin with the point."""

    def __init__(self, points: np.ndarray):
        self.points, n = points, len(points)
        self.f = np.zeros((n, 2, 2))
        self.f[:, 0, 0], self.f[:, 1, 0], self.f[:, 0, 1] = points[:, 0], points[:, 1], 1.0
        r = np.stack((np.ones(n), points[:, 2]), axis=1)
        self.q = r[:, :, None] * r[:, None, :]
        self.ft = self.f.transpose(0, 2, 1)

    def prior(self) -> np.ndarray:
        """The covariance that the law keeps."""
        left = np.eye(4) - np.einsum("nij,nkl->nikjl", self.f, self.f).reshape(-1, 4, 4)
        return np.linalg.solve(left, self.q.reshape(-1, 4, 1)).reshape(-1, 2, 2)

    def start(self, columns: int) -> tuple:
        """The element that does nothing."""
        n = len(self.points)
        zero = np.zeros((n, 2, 2))
        return np.broadcast_to(I2, (n, 2, 2)).copy(), np.zeros((n, 2, columns)), zero, np.zeros((n, 2, columns)), zero.copy()

    def step(self, y: np.ndarray | None, columns: int) -> tuple:
        """One hour's element; y: the values (None where missing)."""
        n = len(self.points)
        if y is None:
            return self.f, np.zeros((n, 2, columns)), self.q, np.zeros((n, 2, columns)), np.zeros((n, 2, 2))
        gain = self.q[:, :, :1]  # over the shock's variance at the observation, 1
        keep = I2 - gain * np.array([[1.0, 0.0]])
        row = self.ft[:, :, :1]
        return keep @ self.f, gain * y, keep @ self.q, row * y, row @ row.transpose(0, 2, 1)

    @staticmethod
    def combined(one: tuple, two: tuple) -> tuple:
        """The element of one stretch and the next."""
        a, b, c, e, j = one
        a2, b2, c2, e2, j2 = two
        d = np.linalg.inv(I2 + c @ j2)
        left, back = a2 @ d, a.transpose(0, 2, 1) @ d.transpose(0, 2, 1)
        return left @ a, left @ (b + c @ e2) + b2, left @ c @ a2.transpose(0, 2, 1) + c2, back @ (e2 - j2 @ b) + e, back @ j2 @ a + j

    @staticmethod
    def onward(state: tuple, element: tuple) -> tuple:
        """Mean and covariance behind a stretch."""
        m, p = state
        a, b, c, e, j = element
        left = a @ np.linalg.inv(I2 + p @ j)
        return left @ (m + p @ e) + b, left @ p @ a.transpose(0, 2, 1) + c

    def element(self, values: np.ndarray) -> tuple:
        """A block's element; values: (hours, columns), NaN where missing."""
        columns = values.shape[1]
        out = self.start(columns)
        for y in values:
            out = self.combined(out, self.step(None if np.isnan(y).any() else y, columns))
        return out

    def run(self, state: tuple, values: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray, int]:
        """The state behind a block, sums of products of one-step errors over their variance, sums of its logarithm, and the count."""
        m, p = state
        products, logs, count = np.zeros((len(self.points), values.shape[1], values.shape[1])), np.zeros(len(self.points)), 0
        for y in values:
            m, p = self.f @ m, self.f @ p @ self.ft + self.q
            if np.isnan(y).any():
                continue
            error, size = y - m[:, 0], p[:, 0, 0]
            products += error[:, :, None] * error[:, None, :] / size[:, None, None]
            logs += np.log(size)
            gain = p[:, :, 0] / size[:, None]
            m = m + gain[:, :, None] * error[:, None, :]
            p = p - gain[:, :, None] * p[:, None, 0, :]
            count += 1
        return (m, p), products, logs, count


def solved(products: np.ndarray, logs: float, count: int) -> tuple[float, np.ndarray, float]:
    """Log likelihood, inputs' coefficients and variance of one point."""
    left = products[1:, 1:]
    beta = np.linalg.lstsq(left, products[1:, 0], rcond=None)[0]
    variance = max(float(products[0, 0] - beta @ products[1:, 0]) / count, 1e-300)
    return -0.5 * (count * (np.log(2 * np.pi * variance) + 1) + logs), beta, variance


class Series:
    """One hourly series in blocks of ``block`` hours: value and inputs; a constant is added. Rows with a null are missing hours; of rows with the same
    ts the greatest counts."""

    def __init__(self, rows: DataFrame, value: str, exog: list[str], block: int = BLOCK):
        self.exog, self.size = ["intercept", *exog], block
        known = rows.select("ts", value, *exog).na.drop().groupBy("ts").agg(F.max(F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([value, *exog])])).alias("v"))
        hour = F.floor(F.unix_timestamp("ts") / 3600)
        ends = known.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).first()
        self.first, self.last = ends["a"], ends["b"]
        if self.first is None:
            return
        self.blocks = range((self.last - self.first) // block + 1)
        place = hour - self.first
        self.rows = settled(known.select(F.floor(place / block).cast("int").alias("block"), F.pmod(place, F.lit(block)).cast("int").alias("at"), F.array("v.c0", F.lit(1.0), *[f"v.c{i + 1}" for i in range(len(exog))]).alias("v")))
        self.spark, self.columns = rows.sparkSession, len(exog) + 2

    def _hours(self, block: int) -> int:
        return min(self.size, self.last - self.first + 1 - block * self.size)

    def _passed(self, work) -> dict[int, bytes]:
        """What ``work`` makes of each block that has rows, pickled."""
        columns, size, total = self.columns, self.size, self.last - self.first + 1

        def run(name: tuple, held: pd.DataFrame) -> pd.DataFrame:
            values = np.full((min(size, total - name[0] * size), columns), np.nan)
            values[held["at"].to_numpy()] = np.stack(held["v"].to_numpy())
            return pd.DataFrame([(name[0], pickle.dumps(work(name[0], values)))], columns=["block", "told"])

        told = self.rows.groupBy("block").applyInPandas(run, "block int, told binary").collect()  # a row a block
        return {r["block"]: pickle.loads(r["told"]) for r in told}

    def starts(self, points: np.ndarray) -> list[tuple]:
        """The state at each block's start and behind the last, for each point: one pass for elements, then in order through the blocks."""
        filters, columns = Filters(points), self.columns
        found = self._passed(lambda _, values: filters.element(values))
        state = (np.zeros((len(points), 2, columns)), filters.prior())
        out = [state]
        for block in self.blocks:
            element = found.get(block)
            if element is None:
                element = filters.element(np.full((self._hours(block), columns), np.nan))
            state = filters.onward(state, element)
            out.append(state)
        return out

    def likelihoods(self, points: np.ndarray) -> list[tuple[float, np.ndarray, float]]:
        """Log likelihood, coefficients of the inputs, and variance at each point; two passes."""
        filters, starts = Filters(points), self.starts(points)
        parts = self._passed(lambda block, values: filters.run(starts[block], values)[1:])
        products, logs, count = (sum(p[i] for p in parts.values()) for i in range(3))
        return [solved(products[k], logs[k], count) for k in range(len(points))]

    def fit(self, passes: int = 14, tolerance: float = 1e-4) -> dict[str, float]:
        """The point of greatest likelihood: a coarse grid over all that stays, then a small one that moves and shrinks."""
        coarse = np.array(list(product((-0.9, -0.4, 0.0, 0.4, 0.8, 1.2, 1.6), (-0.7, -0.3, 0.0, 0.3), (-0.6, 0.0, 0.6))))
        points = coarse[stationary(coarse)]
        told = self.likelihoods(points)
        known = {tuple(p): t for p, t in zip(points.tolist(), told, strict=True)}
        reach = np.array([0.3, 0.25, 0.4])
        centre = max(known, key=lambda p: known[p][0])
        for _ in range(passes):
            grid = np.array([[c + s * r for c, s, r in zip(centre, step, reach)] for step in product((-1, 0, 1), repeat=3)])
            fresh = [p for p in grid[stationary(grid)].tolist() if tuple(p) not in known]
            if fresh:
                known |= {tuple(p): t for p, t in zip(fresh, self.likelihoods(np.array(fresh)), strict=True)}
            best = max(known, key=lambda p: known[p][0])
            if best == tuple(centre):
                reach = reach / 3
                if reach.max() < tolerance:
                    break
            centre = best
        likelihood, beta, variance = known[tuple(centre)]
        m = self.starts(np.array([centre]))[-1][0][0]
        state = m[:, 0] - m[:, 1:] @ beta
        return {**dict(zip(("ar1", "ar2", "ma1"), map(float, centre))), **dict(zip(self.exog, beta.tolist())), "variance": variance, "likelihood": float(likelihood), "state1": float(state[0]), "state2": float(state[1])}


def fit(rows: DataFrame, value: str, exog: list[str], block: int = BLOCK) -> dict[str, float]:
    """ar1, ar2, ma1, the constant's and the inputs' coefficients, variance, likelihood and the state behind the last hour (state1: the last value about
    its inputs; state2: what the last values and the last shock add to the next). Without a row: empty."""
    series = Series(rows, value, exog, block)
    return {} if series.first is None else series.fit()


def forecast(future: DataFrame, model: dict[str, float], exog: list[str], horizon: int = 168) -> DataFrame:
    """ts and forecast for the hours of future (ts, step from 1 to horizon, inputs): the state goes on, the inputs are added."""
    ahead, now = [], np.array([model["state1"], model["state2"]])
    for _ in range(horizon):
        now = np.array([model["ar1"] * now[0] + now[1], model["ar2"] * now[0]])
        ahead.append(float(now[0]))
    inputs = sum((F.col(c) * model[c] for c in exog), F.lit(model["intercept"]))
    return future.filter(F.col("step").between(1, horizon)).select("ts", (F.element_at(F.array(*map(F.lit, ahead)), F.col("step").cast("int")) + inputs).alias("forecast"))
