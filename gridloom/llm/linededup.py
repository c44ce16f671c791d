"""Lines that many documents share, dropped by levelled sorted runs of line hashes.

A run is a table of (hash, documents that hold the line), bucketed and sorted by the 128-bit hash of the line's key. Batches of
documents come one after another. Each new batch's own hashes are counted, merge-anti-joined with the lines that the runs already know to
be common (they need no further count), and added as a run of level 0. Whenever a level holds two runs, they are merged into
one of the next level by a full outer merge join of their buckets, without an exchange, so that with n batches a hash is rewritten about
log2(n) times and no batch meets more than log2(n) + 1 runs.

Hashes are counted before any exchange, so a line that every document holds is one row a task. Dropped lines go back to their documents
by ``join_by_key``: the fewer than 1000 most frequent keys are broadcast, all others meet in an exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.keeping import join_by_key
from gridloom.llm.scratch import Scratch, fresh_name

BLANKS = b" \t\n\x0b\x0c\r"
HASH = ["h", "g"]
#: Hashes a bucket of a run holds about, and buckets at least and at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 18, 8, 8192


def line_key(line: bytes) -> bytes:
    """A line without the six ASCII blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()  # of bytes, lower() changes A-Z alone


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.int64).reshape(len(keys), 2)


def _distinct_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the hashes of its distinct keys, in place of its text (the last column)."""
    for batch in batches:
        keys = [list({line_key(line) for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")} - {b""}) for text in batch.column(batch.num_columns - 1).to_pylist()]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        found = _hashes([k for few in keys for k in few])
        pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(2)], HASH)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pairs)], [*batch.schema.names[:-1], "lines"])


class LineRuns:
    """Levelled runs of (h, g, docs) under a folder that all executors share.

    Lines of ``min_docs`` documents or more are common; from then on their count isn't kept up, so that docs is a lower bound there and
    exact elsewhere.
    """

    def __init__(self, spark: SparkSession, root: str, min_docs: int, buckets: int = LEAST_BUCKETS):
        self.spark, self.root, self.min_docs, self.buckets = spark, root, min_docs, buckets
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def without_common(self, counts: DataFrame) -> DataFrame:
        """counts (h, g, ...) without the lines that a run knows to be common, by merge anti joins bucket by bucket."""
        for name in self.runs():
            common = self.spark.table(name).filter(F.col("docs") >= self.min_docs).select(*HASH)
            counts = counts.join(common.hint("merge"), HASH, "left_anti")
        return counts

    def add(self, lines: DataFrame) -> None:
        """A new batch: (h, g), a row for each document and distinct line of it. Rows with a null are left out."""
        counts = lines.dropna(subset=HASH).groupBy(*HASH).agg(F.count("*").alias("docs")).repartition(self.buckets, *HASH)
        self._place(self._write(self.without_common(counts)), 0)

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            older, newer = self.levels[level]
            self.levels[level] = []
            self._place(self._merged(older, newer), level + 1)

    def _merged(self, older: str, newer: str) -> str:
        """One run of two; their tables go once it is written."""
        docs = F.coalesce("docs", F.lit(0).cast("long")) + F.coalesce("more", F.lit(0).cast("long"))
        both = self.spark.table(older).hint("merge").join(self.spark.table(newer).withColumnRenamed("docs", "more"), HASH, "full")
        name = self._write(both.select(*HASH, docs.alias("docs")))
        self._drop(older)
        self._drop(newer)
        return name

    def common(self) -> DataFrame:
        """h, g, docs of all common lines; merges all levels into one run first."""
        names = self.runs()
        while len(names) > 1:
            names.append(self._merged(names.pop(0), names.pop(0)))  # the smallest first
        self.levels = [[] for _ in self.levels[:-1]] + [names]
        if not names:
            return self.spark.createDataFrame([], "h long, g long, docs long")
        return self.spark.table(names[0]).filter(F.col("docs") >= self.min_docs)

    def release(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = []


def _identified(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with a 128-bit hash of doc_id and text in two columns, and their names. Rows that repeat both share it, and its result."""
    r, s = fresh_name(docs, "row_h", "row_g")
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))]
    return docs.withColumn(r, F.xxhash64(*parts)).withColumn(s, F.xxhash64(F.lit(1), *parts)), [r, s]


def hashed_lines(docs: DataFrame, batches: int, scratch: Scratch) -> DataFrame:
    """batch, row_h, row_g, lines (array of h, g) of every row, as a table cut by batch; one pass over the texts."""
    docs, ids = _identified(docs.select("doc_id", "text"))
    batch = F.pmod(F.col(ids[0]), F.lit(batches)).cast("int").alias("batch")
    found = docs.select(batch, F.col(ids[0]).alias("row_h"), F.col(ids[1]).alias("row_g"), "text").mapInArrow(_distinct_hashes, "batch int, row_h long, row_g long, lines array<struct<h: long, g: long>>")
    path = scratch.path("lines")
    found.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema("row_h long, row_g long, lines array<struct<h: long, g: long>>, batch int").parquet(path)


def common_lines(lines: DataFrame, batches: int, min_docs: int, scratch: Scratch) -> DataFrame:
    """h, g, docs (at least so many) of the lines of min_docs rows or more, batch by batch through the runs; a written table."""
    exploded = lines.select("batch", F.explode("lines").alias("line")).select("batch", "line.h", "line.g")
    total = lines.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    runs = LineRuns(lines.sparkSession, scratch.root, min_docs, int(min(MOST_BUCKETS, max(LEAST_BUCKETS, total // BUCKET_ROWS))))
    for batch in range(batches):
        runs.add(exploded.filter(F.col("batch") == batch).select(*HASH))
    found = scratch.keep(runs.common(), "common")
    runs.release()
    return found


def without_lines(docs: DataFrame, lines: DataFrame, common: DataFrame) -> DataFrame:
    """docs without the common lines (h, g, docs; a written table), with n_lines (before) and n_dropped. lines: ``hashed_lines`` of docs."""
    exploded = lines.select("row_h", "row_g", F.explode("lines").alias("line")).select("row_h", "row_g", "line.h", "line.g")
    gone = join_by_key(exploded, common, HASH, "docs").groupBy("row_h", "row_g").agg(F.collect_set(F.struct(*HASH)).alias("gone"))
    n_lines, n_dropped, bad = fresh_name(docs, "n_lines", "n_dropped", "gone_lines")
    told, ids = _identified(docs)
    gone = gone.select(F.col("row_h").alias(ids[0]), F.col("row_g").alias(ids[1]), F.col("gone").alias(bad))
    joined = told.join(gone, ids, "left").select(*docs.columns, bad)
    at = docs.columns.index("text")

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, lost = [], [], []
            for text, bad in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                split = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                kept = split
                if bad:
                    known, keys = {(b["h"], b["g"]) for b in bad}, [line_key(line) for line in split]
                    of = dict(zip(keys, map(tuple, _hashes(keys).tolist()), strict=True))
                    kept = [line for line, key in zip(split, keys, strict=True) if not key or of[key] not in known]
                texts.append(text if len(kept) == len(split) else b"\n".join(kept).decode("utf-8", "surrogatepass"))
                before.append(len(split))
                lost.append(len(split) - len(kept))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(lost, pa.int64())], [*batch.schema.names[:-1], n_lines, n_dropped])

    schema = joined.drop(bad).withColumns({n_lines: F.lit(0).cast("long"), n_dropped: F.lit(0).cast("long")}).schema
    return joined.mapInArrow(dropped, schema)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4) -> DataFrame:
    """docs with every line dropped whose key is in min_docs or more documents; the columns n_lines and n_dropped are added.

    Lines end at \\n. A line's key is the line without ASCII blanks at its ends, A-Z lower-cased; lines with an empty key stay.
    Every row is a document, whether or not it repeats a doc_id or lacks one. A null text is one empty line and stays null; where all
    lines go, the text is empty. An empty table gives an empty table. n_lines and n_dropped get a leading underscore where docs has
    such a column; all other columns pass through. What is dropped doesn't depend on the number of batches.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = hashed_lines(docs, batches, scratch)
    return without_lines(docs, lines, common_lines(lines, batches, min_docs, scratch))


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten documents or more share."""
    docs = drop_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10),
n AS (SELECT rid, count(*) AS n_lines, count(c.k) AS n_dropped, coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY i), '') AS kept
      FROM l LEFT JOIN c ON l.k = c.k GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM n JOIN d USING (rid)
"""
