"""Document fingerprints: threshold-scaled sketches of shingle hashes, in DataFrame functions.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, whatever the text's length. So the sketch of
a union is the union of sketches, and the share of one document that another contains is estimated from their sketches
without bias, however unequal they are. Text is lower-cased and split at ASCII white space; a shingle's hash is XXH64 over
its words' XXH64.

The estimate's error falls with the hashes kept: with m in the smaller sketch its standard error is at most
sqrt((1 - fraction) / m) / 2. A sketch may be empty, a text of n shingles with a chance of (1 - fraction) ** n; then there is nothing
to compare. The default fraction of a half is for documents of some hundred words; for books a smaller one will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
FRACTION = 1 / 2


def _limit(fraction: float) -> int:
    """Hashes are signed longs: the lowest ``fraction`` of them lie below this."""
    return min(int(-(2**63) + fraction * 2**64), 2**63 - 1)


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """df with the sketch of a text column: the sorted distinct hashes below the fraction.

    Fewer words than a shingle has: one shingle of them all; a null or empty text: no hash. Each step is a column of its own, so
    that none is computed anew for every shingle.
    """
    found, each, every = f"{out}_words", f"{out}_each", f"{out}_every"
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn(found, split).withColumn(each, F.transform(found, lambda w: F.xxhash64(w)))
    n = F.size(each) - (words - 1)
    long = F.transform(F.slice(F.col(each), F.lit(1), F.greatest(n, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(F.col(each), i + k) for k in range(1, words)]))
    short = F.when(F.size(found) > 0, F.array(F.xxhash64(F.array_join(found, " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(every, F.when(n > 0, long).otherwise(short))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.filter(every, lambda h: h < F.lit(_limit(fraction)))))).drop(found, each, every)


def fingerprint(sketch: str) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(F.col(sketch), lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge(a: str, b: str) -> Column:
    """The sketch of two documents taken together: the union of their sketches."""
    return F.array_sort(F.array_union(F.col(a), F.col(b)))


def containment(a: str, b: str) -> Column:
    """The share of a's shingles that b holds too, estimated; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(F.col(a), F.col(b))) / F.size(a))


def likeness(a: str, b: str) -> Column:
    """The share of the smaller document's shingles that the other holds too, estimated; 0 to 1, null where either sketch is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(F.col(a), F.col(b))) / F.least(F.size(a), F.size(b)))


def with_next(docs: DataFrame, carried: list[str], ranges: int, dealt=lambda df: df) -> DataFrame:
    """docs with next_<c> for each carried column: its value in the row with the next doc_id, after the last in the first.

    Null doc_ids come first; rows with the same doc_id, or with none, come in order of ``tie``. doc_ids are cut into ranges of about
    as many rows at quantiles, null ones by their tie, and each range is a window; its last row looks at a copy of the next
    range's first row, which is dealt to it beforehand. So one exchange carries the rows, and the driver holds a row a range.
    ``dealt`` is done to the rows after that exchange, and may add the columns to carry.
    """
    cuts = [x / ranges for x in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in cuts]), F.lit(max(10_000, 10 * ranges)))).first()[0] if cuts else None
    bounds = sorted(set(found or []))
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.array(*[F.lit(x) for x in bounds[::step]]).cast("array<bigint>"), F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    passed = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id")))
    within = F.size(F.filter(F.slice(fine, (passed - 1) * step + 1, F.lit(step)), lambda b: b <= F.col("doc_id")))
    by_tie = F.shiftright(F.col("tie"), 57) - 64  # -128 to -1
    number = F.when(F.col("doc_id").isNull(), by_tie).when(passed == 0, F.lit(0)).otherwise((passed - 1) * step + within).cast("int")
    rows = docs.withColumn("range", number)
    firsts = sorted(rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("head")).collect())  # a row a range
    heads = docs.sparkSession.createDataFrame(
        [(r["range"], r["head"]["doc_id"], r["head"]["tie"], firsts[n - 1]["range"]) for n, r in enumerate(firsts)], "range int, head_id long, head_tie long, before int"
    )
    at_head = (rows["range"] == heads["range"]) & rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["tie"] == heads["head_tie"])
    copies = rows.join(F.broadcast(heads), at_head).groupBy("before").agg(F.min(F.struct(*docs.columns)).alias("head")).select("head.*", F.col("before").alias("range"))
    both = rows.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)))
    order = Window.partitionBy("range").orderBy("copied", F.col("doc_id").asc_nulls_first(), "tie")
    done = dealt(both.repartition("range"))
    return done.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).filter(~F.col("copied")).drop("copied", "range")


def edited_fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text is a text whose last floor(n_chars / 2) code points are replaced by the first as many, or all, of the next
    document. A null text counts as empty. Rows with the same doc_id follow each other in order of their texts' hash; a
    sole row is its own next. A likeness is 1 between equal texts and null where a sketch is empty. Other columns aren't read.
    An empty table gives an empty table.
    """
    ranges = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 20_000)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    own = with_next(rows, ["text", "own"], ranges, lambda df: with_sketch(df, "text", "own", words, fraction)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edit = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    done = with_sketch(own.withColumn("edited", edit), "edited", "changed", words, fraction)
    same = lambda other, likely: F.when(F.col("text") == F.col(other), F.lit(1.0)).otherwise(likely)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("changed").alias("edited_fingerprint"),
        same("edited", likeness("own", "changed")).alias("near_edited"),
        same("next_text", likeness("own", "next_own")).alias("near_next"),
    )


def op6_scaled_sketches(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text; likeness 0 where a sketch is empty, as nothing tells of any."""
    near = {c: F.coalesce(c, F.lit(0.0)) for c in ("near_edited", "near_next")}
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumns(near)
