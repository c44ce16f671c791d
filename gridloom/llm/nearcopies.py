"""Near copies by SimHash and word shingles: one row of each group of texts whose shingle sets are alike.

1. A text becomes the set of its shingles' hashes. Rows with equal sets count once, as a node;
2. candidates are sets whose SimHash are at most ``BITS_APART`` bits apart, found by pigeonring filtering (``simhash.links``). Sets of
   likeness 0.8 are 4 to 14 bits apart, where no chain of segments tells them from other texts. So a second source finds
   those that SimHash can't: sets that agree in all of a band's minima meet in a bucket. A pair of likeness s is missed
   by all bands with a chance of (1 - s ** ROWS) ** BANDS, 6 in 100,000 at 0.8 and less above;
3. candidates joined through shared sets are loose groups, which hold every candidate pair. Within one, every pair's exact Jaccard
   likeness is computed, other than of pairs already joined, and gives the links of a spanning forest;
4. the components of those links are the groups.

A loose group is dealt in blocks of bounded rows and text. At first each block meets itself and the group's first row, which
settles groups of close copies. Groups that fall apart then have every two of their blocks meet, so no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.components import components
from gridloom.llm.keeping import join_by_key
from gridloom.llm.scratch import Scratch, fresh_name, released
from gridloom.llm.simhash import links as simhash_links
from gridloom.llm.simhash import of_hashes

WORDS, LEAST = 5, 0.8
BITS_APART = 2
BANDS, ROWS = 32, 6
#: Shingles whose minima are taken at once.
AT_ONCE = 4_096
#: A block of a loose group holds about so many rows and characters.
BLOCK_ROWS, BLOCK_CHARS = 512, 8_000_000
_DEAL = np.random.default_rng(42)
_TIMES, _PLUS = (_DEAL.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: A-Z lower-cased, words split at ASCII white space.

    Fewer words: one shingle of them all. No word: none.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)] if found else [], np.uint64)
    each, n = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), len(found) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out += each[k : k + n] * _POWERS[k]
    return np.unique(_mixed(out))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima; no key of an empty set."""
    if not len(found):
        return np.array([], np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for low in range(0, len(found), AT_ONCE):
        np.minimum(least, ((found[low : low + AT_ONCE, None] ^ _PLUS) * _TIMES).min(axis=0), out=least)
    keys = (_mixed(least).reshape(BANDS, ROWS) * _POWERS[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return _mixed(keys).view(np.int64)


def forest(sets: list[np.ndarray], least: float, joined: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest among sets of Jaccard likeness ``least`` or more; joined: labels of those joined before."""
    n, labels = len(sets), np.unique(np.arange(len(sets)) if joined is None else joined, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marks, links = np.zeros(len(kinds), np.int64), []
    for i in range(n - 1):
        if (labels[i + 1 :] == labels[i]).all():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        marks[own] = 1
        shared = np.add.reduceat(marks[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        marks[own] = 0
        for j in (np.flatnonzero(shared >= least * (sizes[i] + sizes[i + 1 :] - shared) - 1e-9) + i + 1).tolist():
            if labels[i] != labels[j]:
                links.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return links


def _confirmed(cells: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) among the rows (cell, node, label, text) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, links = None, [], []

        def told() -> list[tuple[int, int]]:
            nodes, labels, sets = zip(*held)
            return [(nodes[a], nodes[b]) for a, b in forest(list(sets), least, list(labels))] if len(held) > 1 else []

        for batch in batches:
            for cell, node, label, text in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3)):
                if cell != now:
                    links += told() if held else []
                    now, held = cell, []
                held.append((node, label, shingles(text.as_py(), words)))
            yield _batch(links)
            links = []
        yield _batch(told() if held else [])

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(run, "a long, b long")


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def groups(rows: DataFrame, ids: list[str], scratch: Scratch, words: int = WORDS, least: float = LEAST, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """ids, the carried columns and ``component`` (a number) of every row. ids tell rows apart that differ in text; rows are read twice, and
    texts are shuffled only of rows that have candidates."""
    named = rows.select(*ids, *carry, F.col("text").cast("string").alias("text"))
    schema = StructType([*named.drop("text").schema.fields, *StructType.fromDDL("digest binary, fp long, keys array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, keys = [], [], []
            for text in batch.column(batch.num_columns - 1):
                found = shingles(text.as_py(), words)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                prints.append(of_hashes(found))
                keys.append(band_keys(found))
            told = [pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *told], [*batch.schema.names[:-1], "digest", "fp", "keys"])

    signed = scratch.keep(named.mapInArrow(run, schema), "signed")
    first = lambda c: F.min_by(c, F.struct(*ids)).alias(c)
    distinct = signed.groupBy("digest").agg(F.min(F.struct(*ids)).alias("row"), F.count("*").alias("n"), first("fp"), first("keys"))
    # numbered once, in a written table
    nodes = scratch.keep(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    prints = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    equal = nodes.join(prints, "fp").filter(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    pigeons = Scratch(scratch.spark, "pigeonring")
    near = simhash_links(prints, pigeons, BITS_APART)
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first")), end)
    near = near.select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    buckets = dealt.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    buckets = scratch.keep(buckets, "buckets")
    banded = join_by_key(dealt, buckets, "key", "n").filter(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    roots = scratch.keep(components(banded.union(equal).union(near), scratch), "loose")
    pigeons.drop()

    wanted = nodes.select("node", "row.*").join(roots, "node")
    members = scratch.keep(named.drop(*carry).join(wanted, ids).dropDuplicates(["node"]).select("node", "root", F.coalesce("text", F.lit("")).alias("text")).withColumn("chars", F.length("text")), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("chars") / block_chars)).cast("int").alias("blocks"), F.count("*").alias("n"))
    sized = scratch.keep(join_by_key(members.select("node", "root"), scratch.keep(sizes, "sizes"), "root", "n"), "sized")
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).otherwise(0)
    # the first row of a loose group goes to each of its blocks
    to = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    cells = sized.select("node", "root", F.explode(to).alias("i")).select("node", F.concat_ws(":", "root", "i").alias("cell"), F.col("node").alias("label"))
    links = scratch.keep(_confirmed(members.select("node", "text").join(cells, "node").select("cell", "node", "label", "text"), words, least), "links")
    joined = scratch.keep(components(links, Scratch(scratch.spark, "confirmed")), "joined")

    labels = sized.filter(F.col("blocks") > 1).join(joined.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = labels.groupBy("root").agg(F.countDistinct("label").alias("n")).filter(F.col("n") > 1).select("root")
    left = scratch.keep(labels.join(apart, "root", "left_semi").withColumn("block", block), "apart")
    if left.limit(1).count():
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        pairs = left.select("node", "root", "label", "block", other).filter(F.col("block") != F.col("other"))
        pairs = pairs.select("node", F.concat_ws(":", "root", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "label")
        more = scratch.keep(_confirmed(members.select("node", "text").join(pairs, "node").select("cell", "node", "label", "text"), words, least), "more")
        joined = scratch.keep(components(links.union(more), Scratch(scratch.spark, "confirmed")), "rejoined")
    told = scratch.keep(nodes.join(joined, "node", "left").select("digest", F.coalesce("root", "node").alias("component"), "n"), "named")
    return join_by_key(signed.drop("fp", "keys"), told, "digest", "n").select(*ids, *carry, "component")


def one_of_each(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id, as it is.

    Rows are linked where their sets of ``words``-word shingles have a Jaccard likeness of ``least`` or more, through others
    too. A null text counts as empty, and empty texts are copies of each other. Of rows repeated under a doc_id one stays in
    each group that it names. Rows without a doc_id all stay. An empty table gives an empty table.

    Rows are told apart by two hashes of doc_id and text, so no copy of the table is written; docs are read three times, and their texts shuffled once.
    """
    with released():
        keys = fresh_name(docs, "row_hash", "row_check")
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = docs.withColumns({keys[0]: F.xxhash64("doc_id", text), keys[1]: F.xxhash64(F.lit(1), text, "doc_id")})
        found = groups(rows, keys, Scratch(docs.sparkSession, "nearcopies"), words, least, carry=("doc_id",)).filter(F.col("doc_id").isNotNull())
        kept = found.groupBy("component").agg(F.min(F.struct("doc_id", *keys)).alias("least")).select(*[F.col("least")[k].alias(k) for k in keys])
        kept = Scratch(docs.sparkSession, "kept", lasting=True).keep(kept.dropDuplicates(keys), "kept")
    (place,) = fresh_name(rows, "place")
    # rows of one doc_id and text are one: the join leaves them side by side
    once = rows.join(kept, keys).withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))).filter(F.col(place) == 1)
    return once.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
