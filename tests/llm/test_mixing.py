"""Poisson mixing: rows against SQL, rates, and defined results for odd rows."""

import statistics

from gridloom.llm import mixing


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(mixing.op1_poisson_mixing(spark, sf_dir), mixing.OP1_SQL) > 0


def test_counts_follow_the_rate(spark):
    for rate in (0.3, 2.5, 150.0):
        df = spark.range(3000).selectExpr("id as doc_id", "'t' as text", "'s' as source")
        mixed = mixing.mix(df, epochs=rate).groupBy("doc_id").count().collect()
        counts = [r["count"] for r in mixed] + [0] * (3000 - len(mixed))
        assert abs(statistics.mean(counts) - rate) < 6 * (rate / 3000) ** 0.5
        assert abs(statistics.variance(counts) / rate - 1) < 0.2


def test_targets(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 10) as text", "if(id % 4 = 0, 'a', 'b') as source")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 5.0)], "source string, weight double")
    rates = {r["source"]: r["rate"] for r in mixing.rates(df, weights).collect()}
    assert abs(rates["a"] - 3.0) < 1e-9 and abs(rates["b"] - 1 / 3) < 1e-9
    mixed = {r["source"]: r["count"] for r in mixing.mix(df, weights).groupBy("source").count().collect()}
    assert abs(mixed["a"] / (mixed["a"] + mixed["b"]) - 0.75) < 0.03


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "", "s", 1), (2, "", "s", 1), (None, "abc", "s", 2), (4, "y" * 300_000, "t", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long")
    mixed = mixing.mix(df, epochs=3.0)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "_copy", "shuffle_key"]
    counts = {}
    for r in mixed.collect():
        counts[(r["doc_id"], r["_copy"])] = counts.get((r["doc_id"], r["_copy"]), 0) + 1
    assert all(n == (2 if doc == 2 else 1) for (doc, _), n in counts.items())
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, spark.createDataFrame([("zz", 1.0)], "source string, weight double")).count() == 0
