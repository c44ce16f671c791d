"""Boosted trees for quantiles, several at once, by histograms: features become bins, and a level of all trees is split from one aggregate.

A pass adds up the pinball loss's slopes by (quantile, node, feature, bin); what the driver looks through for splits is as large as these are
many, whatever the rows. A leaf's value is the quantile of what its rows are off by. Trees are data of the plan and not part of its code, so Spark
compiles a pass once; rows are checkpointed once, as bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import settled

#: Of percentile sketches: a value whose rank is within 1 / this of the wanted one.
ACCURACY = 10_000
TREE = "array<struct<f:array<int>,c:array<int>,v:array<double>>>"


@dataclass
class Boosted:
    """Trees of one depth for each level: a node's feature and the last bin that goes left, and the leaves' values (shrunk)."""

    features: list[str]
    edges: list[list[float]]
    levels: list[float]
    depth: int
    start: list[float]
    trees: list[list[tuple[list[int], list[int], list[float]]]] = field(default_factory=list)

    def binned(self) -> Column:
        """A row's bins: how many edges each feature is above; a null is in the first bin."""
        known = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in self.features]
        over = lambda v, e: F.size(F.filter(F.array(*map(F.lit, e)), lambda x: x < v)) if e else F.lit(0)
        return F.array(*[over(v, e) for v, e in zip(known, self.edges, strict=True)])

    def column(self, trees: list) -> Column:
        if not trees:
            return F.array().cast(TREE)
        return F.array(*[F.struct(F.array(*map(F.lit, f)).alias("f"), F.array(*map(F.lit, c)).alias("c"), F.array(*map(F.lit, v)).alias("v")) for f, c, v in trees]).cast(TREE)

    def node(self, tree: Column, bins: Column, depth: int) -> Column:
        """The node of a tree that a row comes to at a depth, numbered from the root's 0."""
        at = F.lit(0)
        for _ in range(depth):
            at = 2 * at + 1 + (F.get(bins, F.get(tree["f"], at)) > F.get(tree["c"], at)).cast("int")
        return at

    def told(self, bins: Column, k: int) -> Column:
        """The forecast of level k."""
        leaf = lambda s, t: s + F.get(t["v"], self.node(t, bins, self.depth) - (2**self.depth - 1))
        return F.aggregate(self.column(self.trees[k]), F.lit(self.start[k]), leaf)

    def predicted(self, rows: DataFrame, prefix: str = "q") -> DataFrame:
        """rows with a column for each level: the prefix and the level in hundredths."""
        marked = rows.withColumn("boosted_bins", self.binned())
        return marked.withColumns({f"{prefix}{round(100 * q)}": self.told(F.col("boosted_bins"), k) for k, q in enumerate(self.levels)}).drop("boosted_bins")


def best_split(slopes: np.ndarray, counts: np.ndarray, least: int) -> tuple[int, int]:
    """Feature and bin of the greatest gain; slopes, counts: (features, bins) of one node. (0, all bins) where nothing is gained: all go left."""
    g, n = np.cumsum(slopes, axis=1)[:, :-1], np.cumsum(counts, axis=1)[:, :-1]
    all_g, all_n = slopes[0].sum(), counts[0].sum()
    good = (n >= least) & (all_n - n >= least)
    gain = np.where(good, g**2 / np.maximum(n, 1) + (all_g - g) ** 2 / np.maximum(all_n - n, 1) - all_g**2 / max(all_n, 1), 0.0)
    if not gain.size or gain.max() <= 1e-9:
        return 0, counts.shape[1]
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return int(f), int(b)


def quantile_boost(rows: DataFrame, target: str, features: list[str], levels: list[float], trees: int = 20, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10) -> Boosted:
    """Trees for each level. Rows without a target take no part; a null feature lies in its first bin. Without a row the forecasts are 0."""
    known = rows.filter(F.col(target).isNotNull())
    cuts = [F.percentile_approx(F.col(f).cast("double"), F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(ACCURACY)) for f in features]
    row = known.agg(F.percentile_approx(F.col(target).cast("double"), F.array(*map(F.lit, levels)), F.lit(ACCURACY)), *cuts).first()
    edges = [sorted(set(e or [])) for e in row[1:]]
    model = Boosted(features, edges, levels, depth, [float(v) for v in row[0] or [0.0] * len(levels)], [[] for _ in levels])
    if row[0] is None:
        return model
    held = settled(known.select(F.col(target).cast("double").alias("y"), model.binned().alias("x")))
    width = max(len(e) for e in edges) + 1
    for _ in range(trees):
        grown = [([0] * (2**depth - 1), [width] * (2**depth - 1), [0.0] * 2**depth) for _ in levels]
        off = [F.struct(F.lit(k).alias("k"), (F.col("y") - model.told(F.col("x"), k)).alias("off"), F.lit(q).alias("q")) for k, q in enumerate(levels)]
        each = held.select("x", F.explode(F.array(*off)).alias("o")).select("x", "o.*")
        for d in range(depth + 1):
            current = F.array(*[model.column([t])[0] for t in grown])
            placed = each.withColumn("node", model.node(F.get(current, F.col("k")), F.col("x"), d))
            if d == depth:
                values = placed.groupBy("k", "node").agg(*[F.percentile_approx("off", F.lit(q), F.lit(ACCURACY)).alias(f"v{k}") for k, q in enumerate(levels)]).collect()
                for r in values:  # a row a leaf
                    grown[r["k"]][2][r["node"] - (2**depth - 1)] = rate * float(r[f"v{r['k']}"])
                break
            slope = F.when(F.col("off") > 0, F.col("q")).otherwise(F.col("q") - 1)
            cells = placed.select("k", "node", slope.alias("g"), F.posexplode("x").alias("f", "b")).groupBy("k", "node", "f", "b").agg(F.sum("g").alias("g"), F.count("*").alias("n")).toPandas()
            for (k, node), own in cells.groupby(["k", "node"]):
                slopes, counts = np.zeros((len(features), width)), np.zeros((len(features), width))
                slopes[own["f"], own["b"]], counts[own["f"], own["b"]] = own["g"], own["n"]
                grown[k][0][node], grown[k][1][node] = best_split(slopes, counts, least)
        for k, tree in enumerate(grown):
            model.trees[k].append(tree)
    return model
