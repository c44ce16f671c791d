"""Product codes of vectors: one small codebook for each part of a vector, fitted by Lloyd rounds over partition-local heaps.

Components are integers, and so are codebooks and squared distances: results don't depend on the order of sums. Vectors lie in
blocks, each a row of a written table and one task's work at a time. A block has a heap for every entry of every codebook, with the
parts that are assigned to it. A part's key is the slack when it was last scanned, its distance to the second nearest entry (lower bound of
all others) less that to its own (upper bound), plus the entry's cumulative drift at that time. Drift grows each round by how far the
entry moved and the farthest that another one moved. A key that is above the drift proves the assignment, so a round pops from the
heaps' tops only what drift has overtaken, scans those parts exactly against the whole codebook, and pushes them again. Heaps whose
top holds aren't touched.

A round returns what its moved parts add to and take from the entries' sums; the driver holds the codebooks alone (entries x width
integers) and the sums over them. Each round's blocks are a written table, so a lost executor costs one block's round.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.keeping import join_by_key
from gridloom.llm.scratch import Scratch

#: Vectors of a block, at most, and numbers in it.
BLOCK_ROWS, BLOCK_CELLS = 8192, 1 << 20
#: A code is one byte.
MOST_ENTRIES = 256
#: Doubles hold integers exactly up to the first, longs up to the second; beyond, Python's integers are used.
EXACT, LONG = 2**53, 2**63
#: Bounds are doubles: they count as violated within this share of the largest distance that there can be.
SLACK = 1e-9
MOVED = "array<struct<part: int, entry: int, at: int, high: long, low: long>>"


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label, v: floor(scale * component) as longs, of the rows whose vector isn't null and holds no null and no component that
    isn't finite. Rows that repeat a vec_id all stay, as does a null vec_id. What is beyond a long stands at its ends."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("v"))


@dataclass
class Shape:
    """How vectors are cut: into ``parts`` of ``size`` components, none beyond ``largest`` in magnitude."""

    parts: int
    size: int
    largest: int

    @property
    def width(self) -> int:
        return self.parts * self.size

    @property
    def farthest(self) -> int:
        """No squared distance, nor a term of it, is larger."""
        return 4 * self.size * max(self.largest, 1) ** 2

    @property
    def margin(self) -> float:
        return SLACK * float(self.farthest) ** 0.5

    @property
    def storage(self) -> str:
        return "<i2" if self.largest < 1 << 15 else "<i4" if self.largest < 1 << 31 else "<i8"

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """x as a type in which squared distances are exact; that of 64 bits also has room for a block's sums."""
        return x.astype(np.int64 if self.farthest < EXACT or (self.farthest < LONG and self.largest < 1 << 49) else object)

    def distances(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Squared distances of parts (a row each) to the entries of a codebook."""
        if self.farthest < EXACT:
            x, book = x.astype(np.float64), book.astype(np.float64)
            return ((x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)).astype(np.int64)
        x, book = self.numbers(x), self.numbers(book)
        return (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)

    def scan(self, x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part (ties to the lower index), and its slack: how much farther the second nearest is."""
        d = self.distances(x, book)
        code = np.argmin(d, axis=1)
        rows = np.arange(len(d))
        own = np.sqrt(d[rows, code].astype(np.float64))
        if d.shape[1] == 1:
            return code, np.full(len(d), np.inf)
        d[rows, code] = self.farthest * 2 if d.dtype == object else min(self.farthest * 2, LONG - 1)
        return code, np.sqrt(d.min(axis=1).astype(np.float64)) - own


class Block:
    """Some vectors, their codes, and a heap for each part and entry."""

    def __init__(self, shape: Shape, entries: int, x: np.ndarray):
        """x: (vectors, width)."""
        self.shape, self.entries, self.x = shape, entries, x.reshape(len(x), shape.parts, shape.size)
        self.codes = np.zeros((len(x), shape.parts), np.uint8)
        self.keys, self.rows, self.starts = np.zeros(0), np.zeros(0, np.int32), np.zeros(shape.parts * entries + 1, np.int32)

    @classmethod
    def read(cls, shape: Shape, entries: int, n: int, stored: list[bytes]) -> Block:
        x, codes, keys, rows, starts = stored
        block = cls(shape, entries, np.frombuffer(x, shape.storage).reshape(n, shape.width))
        block.codes = np.frombuffer(codes, np.uint8).reshape(n, shape.parts).copy()
        block.keys, block.rows, block.starts = np.frombuffer(keys), np.frombuffer(rows, np.int32), np.frombuffer(starts, np.int32)
        return block

    def stored(self) -> list[bytes]:
        return [self.x.astype(self.shape.storage).tobytes(), self.codes.tobytes(), self.keys.tobytes(), self.rows.tobytes(), self.starts.tobytes()]

    def build(self, books: np.ndarray) -> None:
        """Assigns all parts and makes the heaps; a sorted list is a heap."""
        codes, slacks = zip(*(self.shape.scan(self.x[:, p], books[p]) for p in range(self.shape.parts)), strict=True)
        self.codes = np.stack(codes, axis=1).astype(np.uint8)
        heap = (np.arange(self.shape.parts) * self.entries + self.codes).ravel()
        keys, rows = np.stack(slacks, axis=1).ravel(), np.repeat(np.arange(len(self.x), dtype=np.int32), self.shape.parts)
        order = np.lexsort((rows, keys, heap))
        self.keys, self.rows = keys[order], rows[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(heap, minlength=self.shape.parts * self.entries)))).astype(np.int32)

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """The heaps whose top the drift (parts x entries) has overtaken."""
        filled = np.flatnonzero(self.starts[1:] > self.starts[:-1])
        return filled[self.keys[self.starts[filled]] <= drift.ravel()[filled] + self.shape.margin]

    def settle(self, books: np.ndarray, drift: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Pops what drift has overtaken, scans it, pushes it again. Returns for each part position the rows whose code changed, and
        their codes before; ``codes`` has the new ones."""
        heaps: dict[int, list[tuple[float, int]]] = {}

        def heap(i: int) -> list[tuple[float, int]]:
            if i not in heaps:
                at = slice(self.starts[i], self.starts[i + 1])
                heaps[i] = list(zip(self.keys[at].tolist(), self.rows[at].tolist(), strict=True))
            return heaps[i]

        popped: dict[int, list[int]] = {}
        for i in self.violated(drift).tolist():
            limit, own = float(drift.ravel()[i]) + self.shape.margin, heap(i)
            while own and own[0][0] <= limit:
                popped.setdefault(i // self.entries, []).append(heapq.heappop(own)[1])
        changed = []
        for p, who in popped.items():
            rows = np.array(who)
            codes, slacks = self.shape.scan(self.x[rows, p], books[p])
            for row, code, key in zip(who, codes.tolist(), (slacks + drift[p, codes]).tolist(), strict=True):
                heapq.heappush(heap(p * self.entries + code), (key, row))
            before = self.codes[rows, p].astype(np.int64)
            self.codes[rows, p] = codes
            changed.append((p, rows[codes != before], before[codes != before]))
        if heaps:
            lists = [heaps.get(i) for i in range(len(self.starts) - 1)]
            parts = [(np.array([k for k, _ in h]), np.array([r for _, r in h], np.int32)) if h is not None else (self.keys[slice(*self.starts[i : i + 2])], self.rows[slice(*self.starts[i : i + 2])]) for i, h in enumerate(lists)]
            self.keys, self.rows = (np.concatenate([x[j] for x in parts]) for j in range(2))
            self.starts = np.concatenate(([0], np.cumsum([len(x[0]) for x in parts]))).astype(np.int32)
        return changed

    def sums(self, changed: list[tuple[int, np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """What this block's parts add to each entry: (parts, entries, size + 1) sums, the last of them the count. changed: only what
        those rows add to their new entries and take from the old ones."""
        x = self.shape.numbers(self.x)
        out = np.zeros((self.shape.parts, self.entries, self.shape.size + 1), x.dtype)
        everything = [(p, np.arange(len(x)), None) for p in range(self.shape.parts)]
        for p, rows, before in everything if changed is None else changed:
            own = np.column_stack((x[rows, p], np.ones(len(rows), np.int64))).astype(x.dtype)
            np.add.at(out[p], self.codes[rows, p].astype(np.int64), own)
            if before is not None:
                np.subtract.at(out[p], before, own)
        return out

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the assigned entries, summed over parts, as Python's integers where longs could overflow."""
        near = np.stack([books[p][self.codes[:, p]] for p in range(self.shape.parts)], axis=1)
        wide = self.shape.farthest * self.shape.parts >= LONG
        away = (self.x.astype(object) - near.astype(object)) if wide else self.x.astype(np.int64) - near.astype(np.int64)
        return (away * away).sum(axis=(1, 2))


def _moved(sums: np.ndarray) -> pa.Array:
    """The sums that aren't zero, each split into two longs that can be added up without overflow, as one list."""
    part, entry, at = np.nonzero(sums)
    values = sums[part, entry, at]
    high, low = (values >> 32), (values & 0xFFFFFFFF)
    fields = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(high.astype(np.int64)), pa.array(low.astype(np.int64))]
    return pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.StructArray.from_arrays(fields, ["part", "entry", "at", "high", "low"]))


def _listed(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


STORED = ["x", "codes", "keys", "heap_rows", "starts"]


def _block_row(block: Block, ids: pa.Array, labels: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_listed(ids), _listed(labels), *(pa.array([b], pa.binary()) for b in block.stored()), _moved(sums)], ["ids", "labels", *STORED, "moved"])


@dataclass
class Coded:
    """What a fit gives: the codebooks (parts, entries, size) and the coded vectors (vec_id, label, code, error)."""

    books: np.ndarray
    rows: DataFrame


def _drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each entry, how far it moved and the farthest that another of its codebook moved."""
    moved = np.sqrt(((after - before) ** 2).sum(axis=2).astype(np.float64))
    if moved.shape[1] == 1:
        return moved
    order = np.sort(moved, axis=1)
    return moved + np.where(moved == order[:, -1:], np.where(order[:, -1:] == order[:, -2:-1], order[:, -1:], order[:, -2:-1]), order[:, -1:])


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> Coded:
    """Codebooks after ``rounds`` Lloyd rounds, and every vector's code by them.

    vectors: vec_id, label and v (longs), as ``quantised`` gives them. The codebooks start as the parts of the ``entries`` rows of
    smallest vec_id (ties by v; null vec_ids last), fewer where there are fewer rows; equal entries are kept, and the higher of them
    stay unused. An entry becomes the componentwise floor(sum / count) of its parts; an unused one stays. Shorter vectors count as
    zero where others go on, and all are filled with zeros to a multiple of ``parts``. code: two hex digits a part; error: a long,
    or its end where it is beyond. An empty table gives no rows and no codebook.
    """
    if not 1 <= entries <= MOST_ENTRIES:
        raise ValueError(f"between 1 and {MOST_ENTRIES} entries")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "heaplloyd")
    label = vectors.schema["label"].dataType.simpleString()
    out = f"vec_id long, label {label}, code string, error long"
    n, width, high, low = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if not n:
        return Coded(np.zeros((parts, 0, 1), object), spark.createDataFrame([], out))
    shape = Shape(parts, max(1, -(-width // parts)), max(abs(high or 0), abs(low or 0)))
    least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    entries = len(least)
    start = np.array([list(r["v"]) + [0] * (shape.width - len(r["v"])) for r in least], object)
    books = start.reshape(entries, parts, shape.size).transpose(1, 0, 2)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(shape.width) - F.size("v")))
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // shape.width))
    schema = f"ids array<long>, labels array<{label}>, {', '.join(f'{c} binary' for c in STORED)}, moved {MOVED}"

    def built(books: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, block_rows):
                    few = batch.slice(at, block_rows)
                    block = Block(shape, entries, few.column(2).flatten().to_numpy(zero_copy_only=False).reshape(few.num_rows, shape.width))
                    block.build(books)
                    yield _block_row(block, few.column(0), few.column(1), block.sums())

        return work

    # a task holds an Arrow batch of blocks (spark.sql.execution.arrow.maxBytesPerBatch) and works on one after another
    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, pa.Array, pa.Array]]:
        for i in range(batch.num_rows):
            ids, labels = (batch.column(c).slice(i, 1).flatten() for c in range(2))
            yield Block.read(shape, entries, len(ids), [batch.column(2 + c)[i].as_py() for c in range(len(STORED))]), ids, labels

    def settled(books: np.ndarray, drift: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids, labels in blocks(batch):
                    yield _block_row(block, ids, labels, block.sums(block.settle(books, drift)))

        return work

    def coded(books: np.ndarray, drift: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids, labels in blocks(batch):
                    block.settle(books, drift)
                    codes = [row.tobytes().hex() for row in block.codes]
                    errors = [min(int(e), LONG - 1) for e in block.errors(books)]
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

        return work

    state = scratch.keep(vectors.select("vec_id", "label", padded.alias("v")).mapInArrow(built(books), schema), "round0")
    sums, drift = np.zeros((parts, entries, shape.size + 1), object), np.zeros((parts, entries))
    for turn in range(rounds):
        totals = state.select(F.explode("moved").alias("m")).select("m.*").groupBy("part", "entry", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        for r in totals.collect():  # at most parts x entries x (size + 1) rows, as large as the codebooks
            sums[r["part"], r["entry"], r["at"]] += r["high"] * 2**32 + r["low"]
        counts = sums[:, :, -1:]
        moved = np.where(counts > 0, sums[:, :, :-1] // np.where(counts > 0, counts, 1), books)
        drift, books = drift + _drift(books, moved), moved
        if turn + 1 < rounds:
            state = scratch.keep(state.mapInArrow(settled(books, drift), schema), f"round{turn + 1}")
            scratch.drop(f"round{turn}")
    rows = scratch.keep(state.select("ids", "labels", *STORED).mapInArrow(coded(books, drift), out), "coded")
    scratch.drop(f"round{max(rounds - 1, 0)}")
    return Coded(books, rows)


def label_errors(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (a written table of vec_id, label, code, error) with label_error, the error over equal labels, nulls together; a long, or its
    end where it is beyond. Labels with many rows are broadcast, fewer than 1000 of them; the others meet in a join."""
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = rows.withColumn("label_key", key)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG - 1).cast("decimal(38,0)")).cast("long")
    sums = scratch.keep(keyed.groupBy("label_key").agg(total.alias("label_error"), F.count("*").alias("n_rows")), "labels")
    return join_by_key(keyed, sums, "label_key", "n_rows").drop("label_key")


def op11_heap_lloyd(spark, sf_dir: str) -> DataFrame:
    """Codes of all vectors in 16 parts by 64 entries after two rounds, with errors and the digest of the codebooks."""
    coded = fit(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    digest = hashlib.sha256(",".join(str(x) for x in coded.books.ravel()).encode()).hexdigest()
    rows = label_errors(coded.rows, Scratch(spark, "heaplloyd"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain Lloyd: every part against every entry in each round."""
    nearest = "SELECT p.rid, p.part, min(64 * list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT + c.entry) AS m FROM p JOIN c{i} c ON p.part = c.part GROUP BY ALL"
    book = """SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
        SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
          SELECT a.part, a.m % 64 AS entry, i, sum(p.x[i])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN p ON a.rid = p.rid AND a.part = p.part, (SELECT unnest(range(1, w + 1)) AS i FROM w)
          GROUP BY ALL) GROUP BY part, entry) n ON c.part = n.part AND c.entry = n.entry"""
    rounds = "".join(f"a{i} AS MATERIALIZED ({nearest.format(i=i)}),\nc{i + 1} AS MATERIALIZED ({book.format(i=i)}),\n" for i in range(2))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT CAST(ceil(max(len(v)) / 16.0) AS BIGINT) AS w FROM k),
p AS MATERIALIZED (SELECT rid, part, list_resize(v, 16 * w, 0)[part * w + 1 : (part + 1) * w] AS x FROM k, w, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 64),
{rounds}a2 AS MATERIALIZED ({nearest.format(i=2)}),
e AS (SELECT rid, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM e JOIN k USING (rid)
"""


OP11_SQL = _sql()
