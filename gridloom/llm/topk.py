"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more coordinate, sqrt(M - |x|^2) with M the greatest squared norm; then for a query q (with 0 there) the squared
distance is |q|^2 + M - 2 <q, x>, and the highest inner products are the nearest vectors. Each vector is keyed by its nearest
pivot and its distance r to it. The triangle inequality bounds every distance from below by |d(q, pivot) - r|, and so every
score from above. A cell holds one pivot's vectors sorted by r, cut into annuli. The search has two rounds:

1. a query goes to the ``first`` pivots whose vectors can score highest, there to one cell each; its k-th score so far is a bound that
   its answer must reach;
2. it goes to all other cells that can reach its bound, and there to the annuli, the nearest first, until what an annulus can
   give is under the bound, which rises meanwhile.

Bounds are integers and are compared as such; what floating point tells is only which cells and annuli can be left out, with
slack. Cells of a frequent pivot are dealt by a hash into parts of at most about ``cell_rows``. A task holds one cell and streams
the queries that come to it, so neither a vector that many rows repeat nor the number of queries is bound by a task's memory,
and the index is never copied. Pivots are fitted on a sample of about ``sample`` vectors or four times the pivots (at most
16,384); every vector is indexed, and what the pivots are changes the work but not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

ANNULUS = 256
HITS = "query_id long, vec_id long, score long"
#: Doubles hold integer products exactly up to the first; 64-bit integers up to the second; beyond, Python's integers are used.
EXACT, LONG = 2**53, 2**63
#: The bound of a query that has fewer than k scores.
NONE = -(2**63)
#: Pivots, at most.
MOST_PIVOTS = 4096
#: Cells of a matrix of rows by pivots that a task makes at once; three or four such matrices of doubles are 134 MB.
CELLS = 1 << 22


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * component) as longs. Vectors that are null or hold a null or a component that isn't finite, and null
    vec_ids, are left out. Of rows with the same vec_id the least vector stays, so a repeated row counts once."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.filter(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means, started at evenly spaced rows; sample: rows in the space with the added coordinate."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(rounds):
        near = np.argmin((pivots**2).sum(1) - 2 * sample @ pivots.T, axis=1)
        pivots = np.array([sample[near == i].mean(axis=0) if np.any(near == i) else p for i, p in enumerate(pivots)])
    return pivots


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))))


def _scores(q: np.ndarray, x: np.ndarray, largest: int) -> np.ndarray:
    """Inner products as 64-bit integers, for scores of at most ``largest``; those beyond a long's range stand at its ends."""
    if largest < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if largest < LONG:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, NONE, LONG - 1).astype(np.int64)


def _kth(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each row, without those of the query itself; NONE where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), NONE)
    free = np.where(own, NONE, scores)
    return np.partition(free, free.shape[1] - k, axis=1)[:, free.shape[1] - k]


class _Cell:
    """One cell's vectors, by their distance from the pivot."""

    def __init__(self, parts: list[tuple], pivot: np.ndarray):
        self.pivot = pivot
        self.ids, self.v, self.r = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.starts = np.arange(0, len(self.r), ANNULUS)
        self.inner, self.outer = self.r[self.starts], self.r[np.minimum(self.starts + ANNULUS, len(self.r)) - 1]

    def search(self, ask: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, reach, largest: int) -> tuple[np.ndarray, ...]:
        """query, vector and score of all that reach the query's bound, k at most for each query."""
        flat, bound, found = np.column_stack((q.astype(np.float64), np.zeros(len(q)))), bound.copy(), []
        upper = reach(flat, np.sqrt(((flat - self.pivot) ** 2).sum(1))[:, None], self.inner, self.outer)
        turn = np.argsort(-upper, axis=1, kind="stable")  # each query's annuli, the nearest first
        for step in range(len(self.starts)):
            for annulus in np.unique(turn[:, step]).tolist():
                who = np.flatnonzero((turn[:, step] == annulus) & (upper[:, annulus] >= bound))
                if len(who):
                    own = slice(self.starts[annulus], self.starts[annulus] + ANNULUS)
                    scores, same = _scores(q[who], self.v[own], largest), ask[who][:, None] == self.ids[own]
                    bound[who] = np.maximum(bound[who], _kth(scores, same, k))
                    row, column = np.nonzero((scores >= bound[who][:, None]) & ~same)
                    found.append((who[row], self.ids[own][column], scores[row, column]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        who, vec, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        keep = score >= bound[who]
        who, vec, score = who[keep], vec[keep], score[keep]
        best = np.lexsort((vec, np.invert(score), who))  # inverted, scores fall without overflow
        who, vec, score = who[best], vec[best], score[best]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
        keep = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)])) < k
        return ask[who[keep]], vec[keep], score[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = 4096, first: int = 4, cell_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products over all other rows, ties to smaller vec_ids.

    vectors: vec_id and v, longs, as ``quantised`` makes them; shorter vectors count as zero where others go on, so that an empty one
    scores 0 with all. is_query is a condition on vec_id. With fewer than k other rows a query gets them all; an empty table
    gives an empty table. Scores beyond a long stand at its ends, and tie there.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    rows = scratch.keep(vectors, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, most, high, low = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, largest = max(width, 1), max(width, 1) * max(abs(high or 0), abs(low or 0)) ** 2
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    rows = rows.select("vec_id", padded.alias("v"))
    cell_rows, count = cell_rows or int(min(65_536, max(1024, 4 * n**0.5))), int(min(MOST_PIVOTS, max(16, n**0.5 / 4)))
    share = min(1.0, max(sample, 4 * count) / n)
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow()  # bounded by the sample's size
    pivots = fit_pivots(_lifted(_numbers(some.column(0).combine_chunks(), width), most) if len(some) else np.zeros((1, width + 1)), count)
    slack = 1e-6 * (most + 1)
    few_rows = max(1, CELLS // max(len(pivots), width))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of which no matrix of rows by pivots has more than CELLS cells."""
        for batch in batches:
            for at in range(0, batch.num_rows, few_rows):
                yield batch.slice(at, few_rows)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x = _lifted(_numbers(batch.column(1), width), most)
            away = np.maximum((x * x).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0)
            near = np.argmin(away, axis=1) if len(x) else np.zeros(0, int)
            r = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(r)], ["vec_id", "v", "pivot", "r"])

    index = scratch.keep(rows.mapInArrow(keyed, "vec_id long, v array<long>, pivot int, r double"), "index")
    parts = F.ceil(F.count("*") / cell_rows).cast("int").alias("parts")
    rings = scratch.keep(index.groupBy("pivot").agg(parts, F.min("r").alias("low"), F.max("r").alias("high")), "rings")  # a row a pivot, MOST_PIVOTS at most
    lows, highs = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for x in rings.collect():
        lows[x["pivot"]], highs[x["pivot"]] = x["low"], x["high"]
    parts = F.broadcast(rings.select("pivot", "parts"))
    home = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int")
    cells = index.join(parts, "pivot").select("vec_id", "v", "pivot", home.alias("part"), "r")

    def reach(q: np.ndarray, d: np.ndarray, low, high) -> np.ndarray:
        """The highest score that vectors between the distances low and high from a pivot can have, q at d from it."""
        gap = np.maximum(0, np.maximum(d - high, low - d))
        return ((q * q).sum(1)[:, None] + most - gap * gap) / 2 + slack

    there = np.flatnonzero(np.isfinite(lows))

    def uppers(q: np.ndarray) -> np.ndarray:
        """For each query and each pivot of ``there``, the highest score that a vector of the pivot can have."""
        q = np.column_stack((q.astype(np.float64), np.zeros(len(q))))
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (pivots[there] ** 2).sum(1) - 2 * q @ pivots[there].T, 0))
        return reach(q, d, lows[there], highs[there])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            turn = np.argsort(-uppers(_numbers(batch.column(1), width)), axis=1, kind="stable")[:, :first]
            to = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * turn.shape[1]), pa.array(there[turn].ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, to], ["vec_id", "v", "tried"])

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, at = np.nonzero(uppers(_numbers(batch.column(1), width)) >= batch.column(3).to_numpy()[:, None])
            for few in np.array_split(np.arange(len(row)), len(row) // 4096 + 1):  # so that no batch holds many copies of a query
                columns = batch.take(pa.array(row[few])).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(there[at[few]].astype(np.int32))], ["vec_id", "v", "tried", "bound", "pivot"])

    # written once, so that the second round knows where each query has been
    queries = scratch.keep(rows.filter(is_query).mapInArrow(nearest, "vec_id long, v array<long>, tried array<int>"), "queries")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cell = None, [], None
        for batch in batches:
            pivot, part, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            v, r, bound = _numbers(batch.column(4), width), batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for at in np.split(np.arange(len(ids)), cuts) if len(ids) else []:
                key = (pivot[at[0]], part[at[0]])
                if key != now:
                    now, held, cell = key, [], None
                if not asks[at[0]]:
                    held.append((ids[at], v[at], r[at]))
                elif held:
                    cell = cell or _Cell(held, pivots[key[0]])
                    hits = cell.search(ids[at], v[at], bound[at], k, reach, largest)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()) for h in hits], ["query_id", "vec_id", "score"])

    def hits(asked: DataFrame) -> DataFrame:
        """What the queries (vec_id, v, bound, pivot, part) find in their cells. A cell's vectors come before its queries."""
        held = cells.select("pivot", "part", F.lit(0).alias("asks"), "vec_id", "v", "r", F.lit(NONE).cast("long").alias("bound"))
        both = held.unionByName(asked.select("pivot", "part", F.lit(1).alias("asks"), "vec_id", "v", F.lit(0.0).alias("r"), "bound"))
        return both.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "asks", "r").mapInArrow(searched, HITS)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    starts = queries.select("vec_id", "v", F.lit(NONE).cast("long").alias("bound"), F.explode("tried").alias("pivot"))
    early = scratch.keep(hits(starts.join(parts, "pivot").withColumn("part", home)), "early")
    kth = early.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = queries.join(kth, "vec_id", "left").select("vec_id", "v", "tried", F.coalesce("bound", F.lit(NONE).cast("long")).alias("bound"))
    more = bounded.mapInArrow(onward, "vec_id long, v array<long>, tried array<int>, bound long, pivot int").join(parts, "pivot").withColumn("home", home)
    more = more.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).filter(~F.array_contains("tried", F.col("pivot")) | (F.col("part") != F.col("home")))
    late = hits(more)
    return early.unionByName(late).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    """For every 20th vector, the 20 others with the highest inner product."""
    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 20 == 0)

OP5_SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
