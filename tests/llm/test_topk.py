"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import topk


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(topk.op5_pivot_top_k(spark, sf_dir), topk.OP5_SQL) > 0


def brute(v, ids, k):
    out = {}
    for q in ids:
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v[q], v[x])), x) for x in ids if x != q))[:k]
            out[q] = [(x, -s) for s, x in scores]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_crowds_and_ties(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-60, 60, (600, 9))
    v[100:400] = v[100]  # a vector that half the rows repeat
    rows = [(i, [float(x) / 64 for x in r]) for i, r in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0, k=7, cell_rows=50))
    assert got == brute({i: r for i, r in enumerate(v.tolist())}, range(600), 7)


@pytest.mark.parametrize("low, high", [(2**26, 2**29), (-(2**30), 2**30), (2**33, 2**36)])
def test_large_components(spark, low, high):
    v = np.random.default_rng(low % 97).integers(low, high, (600, 2))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "vec_id long, v array<long>")
    want = brute(v.astype(object).tolist(), range(600), 5)
    held = lambda s: max(-(2**63), min(s, 2**63 - 1))
    if high**2 * 2 < 2**63:
        assert found(topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, cell_rows=40)) == want
    else:  # beyond a long all scores stand at its end and tie
        assert [s for _, s in found(topk.top_k(df, F.col("vec_id") % 20 == 0, k=5))[0]] == [held(s) for _, s in want[0]]


def test_empty_vectors_score_zero(spark):
    rows = spark.createDataFrame([(i, []) for i in range(30)], "vec_id long, embedding array<float>")
    got = found(topk.top_k(topk.quantised(rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(i, 0) for i in range(1, 21)], 20: [(i, 0) for i in range(20)]}


def test_odd_rows(spark):
    big = 1e12
    rows = [(0, [1.0, 2.0], "a"), (20, [float("nan"), 1.0], "a"), (40, None, "a"), (60, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (1, [big, -big], "a"), (2, [0.5], "a"), (2, [0.5], "a"), (3, [], "a"), (4, [float("inf"), 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = found(topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0, k=20))
    one = int(big) * 64
    assert got == {0: [(2, 64 * 32), (3, 0), (1, 64 * one - 128 * one)]}
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(topk.quantised(df.filter("vec_id = 0")), F.col("vec_id") % 20 == 0).count() == 0
