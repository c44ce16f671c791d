"""Secrets in text, with multipart credential linking, in DataFrame functions.

Strong kinds are reported by themselves: an assignment of a value to a secret's name, an access identifier, a long hex run. Weak
kinds, a run that could be a secret key and an endpoint, are ordinary text by themselves. They are reported only where
complementary parts stand within ``scope`` code points: a key near an access identifier; an endpoint near an access
identifier and near a key or an assignment.

Texts are read in one pass that keeps only lengths: of each match, and of the text before it. Places are running sums of
those, per text and kind. The link is an interval join: spans are dealt into buckets of ``scope`` code points; a bucket's anchors
are reduced to their least and greatest place before the join, which tell for the bucket and both its neighbours whether one
is near enough. So a text full of identifiers makes no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch, fresh_name

#: Kinds in the order in which spans with the same start are listed. The first three patterns and least lengths are given.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "key": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "endpoint": r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]{1,5})?",
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
SCOPE = 300


def _matches(kind: str, text: str) -> F.Column:
    """array of (kind, gap, len, good): code points before a match since the last one, and its own; [] if there is none."""
    pattern = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    good = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE) if kind == "assign" else (lambda m: F.lit(True))
    told = F.zip_with(
        hits,
        F.slice(F.split(F.col(text), PATTERNS[kind], -1), F.lit(1), F.size(hits)),
        lambda m, gap: F.struct(F.lit(kind).alias("kind"), F.char_length(gap).alias("gap"), F.char_length(m).alias("len"), good(m).alias("good")),
    )
    return F.when(F.col(text).rlike(PATTERNS[kind]), told)


def spans(found: DataFrame) -> DataFrame:
    """rid, kind, start, stop of each good match; found: rid and an array per kind as ``_matches`` makes it."""
    rows = found.select("rid", F.explode(F.array(*[F.col(k) for k in PATTERNS])).alias("of")).filter(F.col("of").isNotNull())
    each = rows.select("rid", F.posexplode("of").alias("nth", "m")).select("rid", "nth", "m.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(so_far))
    return placed.filter("good").select("rid", "kind", (F.col("stop") - F.col("len")).alias("start"), "stop")


def near(weak: DataFrame, anchors: DataFrame, scope: int) -> DataFrame:
    """The rows of weak with an anchor of the same rid whose start is at most ``scope`` away."""
    bucket = F.floor(F.col("start") / scope)
    ends = anchors.groupBy("rid", bucket.alias("bucket")).agg(F.min("start").alias("least"), F.max("start").alias("most"))
    tried = weak.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    joined = tried.join(ends, ["rid", "bucket"])
    own = F.col("bucket") == bucket
    hit = own | (F.col("least").between(F.col("start") - scope, F.col("start") + scope)) | (F.col("most").between(F.col("start") - scope, F.col("start") + scope))
    return joined.filter(hit).select("rid", "kind", "start", "stop").distinct()


def linked(all_spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans to report: every strong one, and the weak ones whose complementary parts are near."""
    of = lambda *kinds: all_spans.filter(F.col("kind").isin(*kinds))
    keys = near(of("key"), of("access"), scope)
    endpoints = near(near(of("endpoint"), of("access"), scope), of("key", "assign"), scope)
    return of(*BASE).unionByName(keys).unionByName(endpoints)


def scan(docs: DataFrame, scratch: Scratch, scope: int = SCOPE, keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows, spans, and the names of three columns that clash with none of docs: rid, hit and spans.

    Rows: a written table of the columns to keep, rid, which numbers the rows, and hit, whether a pattern matched. Spans: per rid
    with any span to report, the array of (start, rank, kind, stop) in order of start, then kind.
    """
    text, rid, hit, found, listed = fresh_name(docs, "scan_text", "scan_rid", "scan_hit", "scan_found", "scan_spans")
    matches = F.struct(*[_matches(k, text).alias(k) for k in PATTERNS])
    read = docs.withColumn(text, F.coalesce(F.col("text"), F.lit(""))).select(*keep, matches.alias(found))
    any_of = reduce(lambda a, b: a | b, [F.col(found)[k].isNotNull() for k in PATTERNS])
    rows = scratch.keep(read.withColumn(hit, any_of).withColumn(rid, F.monotonically_increasing_id()), "rows")
    every = scratch.keep(spans(rows.filter(hit).select(F.col(rid).alias("rid"), f"{found}.*")), "spans")
    rank = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind"))
    ordered = F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "stop")))
    return rows.drop(found), linked(every, scope).groupBy(F.col("rid").alias(rid)).agg(ordered.alias(listed)), [rid, hit, listed]


def _listed(column: F.Column) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs.

    Places are code points of the whole text, ends exclusive. A null text counts as empty; without spans the counts are 0 and
    spans is empty. Repeated rows and null doc_ids each have their row. Other columns aren't read. An empty table
    gives an empty table.
    """
    rows, found, (rid, _, listed) = scan(docs, Scratch(docs.sparkSession, "secrets"), scope)
    got = F.coalesce(listed, F.expr("cast(array() as array<struct<start:bigint,rank:bigint,kind:string,stop:bigint>>)"))
    count = lambda kind: F.size(F.filter("got", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("got", lambda s: s["kind"].isin(*BASE))
    joined = rows.join(found, rid, "left").withColumn("got", got)
    return joined.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("got")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with each span replaced by mask, overlapping ones as one, and n_chars (where docs has it) set anew.

    Rows without spans pass as they are, a null text too. All columns are kept. Only texts with some match are exchanged.
    """
    rows, found, (rid, hit, spans) = scan(docs, Scratch(docs.sparkSession, "redaction"), scope, tuple(docs.columns))
    text = F.col("text")
    piece = lambda acc, s: F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
    out = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["stop"] <= acc["at"], acc).otherwise(
            F.struct(F.concat(acc["out"], piece(acc, s), F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.lit(mask))).alias("out"), s["stop"].cast("long").alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))),
    )
    masked = rows.filter(hit).join(found, rid, "left").withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(out))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.filter(~F.col(hit)).select(*docs.columns).unionByName(masked.select(*docs.columns))


def op10_credential_linking(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
