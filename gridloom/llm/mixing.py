"""Mixing sources to target weights by Poisson replication, in DataFrame functions.

Each document is repeated k times, k from a Poisson distribution whose mean is its source's target repetition rate. The draw
inverts the distribution at a number hashed from the seed and doc_id, so that a lost task draws the same again. Copies are then
dealt over partitions and sorted there by a hash of the copy: a global shuffle in one exchange.

Masses of sources are sums made before the exchange. The table of rates has a row per source and is written, so that its size
is known to the planner: it is broadcast under Spark's own threshold, and joined by an exchange with skew handling beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch, fresh_name

#: A rate above this is drawn as the sum of several draws of an equal share, whose distributions stay within doubles.
RATE_A_DRAW = 64.0
#: Of 52 hashed bits.
STEPS = float(1 << 52)


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, rate: how often a document of each source is to appear on average.

    weights: a table (source, weight) of target shares; a source that it lacks has weight 0, and a negative or null
    weight counts as 0. Without it a source's share is its mass to the power ``temperature``. A source's mass is the code
    points of its texts. The mixture's mass is ``epochs`` times that of all documents. A source without mass gets the rate
    ``epochs`` (with weights: if its weight isn't 0). A null source is a source. Where no source with mass has a weight, their rates are 0.
    """
    mass = docs.groupBy("source").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).cast("double").alias("mass"))
    if weights is None:
        weighed = mass.withColumn("weight", F.pow("mass", F.lit(temperature)))
    else:
        told = weights.groupBy(F.col("source").alias("told")).agg(F.sum("weight").alias("weight"))
        weighed = mass.join(told, F.col("source").eqNullSafe(F.col("told")), "left").drop("told")
        weighed = weighed.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    total = weighed.agg(F.sum("mass").alias("all_mass"), F.sum(F.when(F.col("mass") > 0, F.col("weight"))).alias("all_weight"))
    target = F.coalesce(F.try_divide(F.lit(epochs) * F.col("all_mass") * F.col("weight"), "all_weight") / F.col("mass"), F.lit(0.0))
    bare = F.lit(epochs) if weights is None else F.when(F.col("weight") > 0, F.lit(epochs)).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(total)).select("source", F.when(F.col("mass") > 0, target).otherwise(bare).alias("rate"))  # total: one row


def _distribution(table: DataFrame) -> DataFrame:
    """Adds draws, how many draws make a count, and cdf, the chance of at most k for k from 0 of one of them."""
    draws = F.greatest(F.ceil(F.col("rate") / RATE_A_DRAW), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("draws")
    chances = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 25).cast("int")),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * F.col("mean") / k).alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return table.withColumn("draws", draws).withColumn("mean", mean).withColumn("cdf", chances).drop("mean")


def hashed(*parts) -> F.Column:
    """52 bits of MD5 over the parts as text, as a long; null parts are empty."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """docs, each repeated as its source's rate asks, in an order that a hash gives; with copy (from 1) and shuffle_key.

    Rows come sorted by shuffle_key within partitions dealt by it. copy and shuffle_key get a leading underscore where docs
    has such a column. Rows with the same key get the same count, so repeated rows are repeated alike; a null key
    hashes like an empty one. A null text has mass 0. An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    copy, shuffle_key, source, draws, cdf, count = fresh_name(docs, "copy", "shuffle_key", "mix_source", "mix_draws", "mix_cdf", "mix_count")
    table = scratch.keep(_distribution(rates(docs, weights, temperature, epochs)), "rates")
    table = table.select(F.col("source").alias(source), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(draws)),
        F.lit(0),
        lambda n, j: n + F.size(F.filter(F.col(cdf), lambda c: c <= hashed(F.lit(seed), key, j) / STEPS)),
    )
    counted = docs.join(table, docs["source"].eqNullSafe(table[source])).withColumn(count, drawn).filter(F.col(count) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(source, draws, cdf, count)
    placed = copies.withColumn(shuffle_key, hashed(F.lit(seed), F.lit("order"), key, copy))
    return placed.repartition(F.col(shuffle_key)).sortWithinPartitions(shuffle_key, key, copy)


def op1_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed at temperature 0.5 over sources, one epoch in mass."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
WITH RECURSIVE s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS mass FROM documents GROUP BY source),
w AS (SELECT source, mass, pow(mass, 0.5) AS weight, sum(mass) OVER () AS all_mass,
             sum(CASE WHEN mass > 0 THEN pow(mass, 0.5) END) OVER () AS all_weight FROM s),
r AS (SELECT source, CASE WHEN mass > 0 THEN all_mass * weight / all_weight / mass ELSE 1.0 END AS rate FROM w),
d AS (SELECT source, greatest(CAST(ceil(rate / 64.0) AS INTEGER), 1) AS draws, rate / greatest(ceil(rate / 64.0), 1) AS mean FROM r),
c AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM d
      UNION ALL
      SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c WHERE k + 1 <= ceil(mean + 12 * sqrt(mean) + 25)),
t AS (SELECT x.doc_id, x.text, x.lang, x.source, x.n_chars, j.j,
             CAST('0x' || substr(md5('42:' || coalesce(CAST(x.doc_id AS VARCHAR), '') || ':' || j.j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM (SELECT *, row_number() OVER () AS rn FROM documents) x
      JOIN d ON x.source IS NOT DISTINCT FROM d.source, generate_series(1, d.draws) AS j(j)),
n AS (SELECT t.doc_id, t.text, t.lang, t.source, t.n_chars, t.j, count(*) AS n
      FROM t JOIN c ON t.source IS NOT DISTINCT FROM c.source AND c.cdf <= t.u GROUP BY ALL),
m AS (SELECT doc_id, text, lang, source, n_chars, CAST(sum(n) AS INTEGER) AS n FROM n GROUP BY ALL)
SELECT m.doc_id, m.text, m.lang, m.source, m.n_chars, CAST(g.copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('42:order:' || coalesce(CAST(m.doc_id AS VARCHAR), '') || ':' || g.copy), 1, 13) AS BIGINT) AS shuffle_key
FROM m, generate_series(1, m.n) AS g(copy)
"""
