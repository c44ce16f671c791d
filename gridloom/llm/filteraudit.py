"""How filters interact: what each order of filters keeps, removes and loses, from counts of failure masks by part.

A document's mask has a bit for each filter that it fails. Counts by part and mask are all that the audit needs: with k filters at
most 2^k rows a part, summed before any exchange. A subset-zeta transform turns a part's counts into the survivors of every subset
of filters, in k rounds over an array of 2^k: a document survives a subset if its mask lies within the complement, so survivors of
S are the sum of counts over all masks within the complement of S. A step of an order is then a difference between two neighbouring
subsets, for documents and for each label alike.

Copies: a text fails E if a smaller doc_id has it anywhere in the table. Each text's smallest doc_id is a pre-aggregated minimum over
128-bit hashes, and rows meet it by (hash, doc_id), not by hash, so a text that very many rows share is no task's burden.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

FILTERS = "ABCDE"
#: All orders of more filters than these would be too many rows a part.
MOST_FILTERS = 7
MARKS = re.compile(rb"[#$%&*|]")
NOT_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))


def text_mask(text: str) -> int:
    """Bits 0 to 3 for filters A to D: few words, few distinct words, many capitals, marks."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at exactly the six ASCII blanks
    short, dull = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return short | dull << 1 | (100 * len(raw.translate(None, NOT_CAPITALS)) > 3 * len(text)) << 2 | bool(MARKS.search(raw)) << 3


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        keys = pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
        masks = pa.array(np.array([text_mask(t) for t in texts], np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, masks], ["doc_id", "part", "text_key", "mask"])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part (the language; null: empty), mask, good, toxic (0 or 1) of every row of docs.

    A null text counts as empty. Rows that repeat a doc_id are documents of their own; none of them is a copy of another of the same
    doc_id. A row without a doc_id is no copy, nor are others copies of it, and no label is its own. Where labels repeat a doc_id,
    one mark of 1 is enough. Columns other than doc_id, text, lang (of docs), quality and toxic (of labels) play no part.
    """
    scratch = Scratch(docs.sparkSession, "filteraudit")
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    told = scratch.keep(asked.mapInArrow(_masked, "doc_id long, part string, text_key binary, mask int"), "masks")
    named, unnamed = told.filter(F.col("doc_id").isNotNull()), told.filter(F.col("doc_id").isNull())
    first = named.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.when(F.col("is_first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    joined = named.join(first, ["text_key", "doc_id"], "left").withColumn("mask", F.col("mask").bitwiseOR(copy)).join(marks, "doc_id", "left")
    columns = ["doc_id", "part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))]
    return joined.select(*columns).unionByName(unnamed.select("doc_id", "part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def survivors(masked: DataFrame, sums: dict[str, Column], bits: int) -> DataFrame:
    """part and, for each of sums (a number of each row), an array whose element S is its total over rows that fail no filter of S.

    masked: part and mask. A part has one row of at most 2^bits cells, whatever its documents; an empty table gives no part.
    """
    full = (1 << bits) - 1
    cells = masked.groupBy("part", "mask").agg(*(F.sum(c.cast("long")).alias(name) for name, c in sums.items()))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *sums)).alias("cells"))
    dense = lambda name: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda i: F.aggregate(F.filter("cells", lambda c: c["mask"] == i), F.lit(0).cast("long"), lambda s, c: s + c[name]))
    # each round reads the one before, so every round is a column of its own and not an expression nested in itself
    out = parts.select("part", *(dense(name).alias(name) for name in sums))
    for bit in range(bits):
        one = lambda name, bit=bit: F.transform(F.col(name), lambda x, i: F.when(i.bitwiseAND(1 << bit) != 0, x + F.get(F.col(name), i.bitwiseAND(full ^ (1 << bit)))).otherwise(x))
        out = out.select("part", *(one(name).alias(name) for name in sums))
    return out.select("part", *(F.reverse(F.col(name)).alias(name) for name in sums))  # the complement of S stands at full - S


def audit(masked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, each order
    of the filters and each step. masked: part, mask (bit i for the i-th of filters), good, toxic, as ``masks`` gives them."""
    k, full = len(filters), (1 << len(filters)) - 1
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    table = survivors(masked, {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}, k)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = table.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda letter: F.element_at(F.array(*(F.lit(1 << i) for i in range(k))), F.instr(F.lit(filters), letter))
    letters = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring("filter_order", i, F.lit(1)))
    before = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda s, letter: s + bit(letter))
    steps = steps.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)
    at = lambda name, subset: F.get(F.col(name), subset)
    after, alone = F.col("before") + F.col("own"), F.lit(full) - F.col("own")
    removed = lambda name: at(name, F.col("before")) - at(name, after)
    # a subset S of the other filters comes before the filter, and the rest behind it, in |S|! (k - 1 - |S|)! orders
    weights = F.array(*(F.lit(factorial(s.bit_count()) * factorial(max(k - 1 - s.bit_count(), 0))).cast("long") for s in range(full + 1)))
    others = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda t, s: t + F.get(F.col("weights"), s) * (at("n", s) - at("n", s + F.col("own"))))
    return steps.withColumn("weights", weights).select(
        "part", "filter_order", "step",
        at("n", after).alias("kept"), removed("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", F.col("own")) - removed("n")).alias("redundant"),
        (at("n", alone) - at("n", F.lit(full))).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    return audit(masks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: By the plain way: each mask meets each order, and is removed at the first filter that it fails.
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.part, list_filter([
        CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > first THEN 'E' END], lambda x: x IS NOT NULL) AS fails,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL
      SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM o, generate_series(1, 5) AS g(step) WHERE length(filter_order) = 5),
f AS (SELECT c.*, filter_order, list_min(list_transform(fails, lambda x: instr(filter_order, x))) AS gone FROM c, o WHERE length(filter_order) = 5),
r AS (SELECT f.part, s.filter_order, s.step, s.f,
        sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN list_contains(fails, s.f) AND gone < step THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = [s.f] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
      FROM f JOIN s ON f.filter_order = s.filter_order GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
