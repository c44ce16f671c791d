"""Toxicity on held-out labels, and the risk estimator's parts."""

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import toxicity


def test_held_out_documents(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in toxicity.op2_nnpu_toxicity(spark, larger).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [(rows[i]["score"], y) for i, y in marks.items() if i in rows and rows[i]["held_out"]]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert bad and good
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    hits = np.mean([(s >= 0.5) == bool(y) for s, y in held])
    assert auc >= 0.9 and hits >= 0.9


def test_non_negative_risk_learns_through_hidden_positives():
    """Against the Bayes rule of the same draw: no rule finds more than 78.4 % of these toxic rows at even odds (two or three of
    their three marks), so that is what to come near, not a fixed share."""
    rng = np.random.default_rng(1)
    chance = lambda toxic: np.where(np.arange(6) < 3, 0.7 if toxic else 0.05, 0.4)
    make = lambda n, toxic: (rng.random((n, 6)) < chance(toxic)).astype(np.float32)
    positive, unlabelled = make(3000, True), np.concatenate((make(2000, True), make(8000, False)))
    w, b = toxicity.train(positive, unlabelled, 0.2)
    rows = np.concatenate((make(5000, True), make(5000, False)))
    likely = [np.prod(np.where(rows == 1, chance(toxic), 1 - chance(toxic)), axis=1) for toxic in (True, False)]
    best = 0.2 * likely[0] >= 0.8 * likely[1]
    assert ((toxicity.sigmoid(rows @ w + b) >= 0.5) == best).mean() > 0.99


def test_scores_against_a_plain_dense_model(spark, sf_dir):
    """What the tasks score is the mean of the bags' logistic models over a text's words and their beginnings, each once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    models = toxicity.fit(docs, marks, positives=200, unlabelled=100, bags=3, vocabulary=60)
    assert len(models) == 3 and any(weights for weights, _ in models)
    for r in toxicity.score(docs, models, "score").collect():
        words = {w for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower())}
        seen = words | {f"{w[:k]}-" for w in words for k in (4, 5, 6) if len(w) > k}
        each = [1 / (1 + math.exp(-(bias + sum(x for f, x in weights.items() if f in seen)))) for weights, bias in models]
        assert abs(r["score"] - sum(each) / len(each)) < 1e-9


def test_unlabelled_are_documents_at_large(spark):
    """Rows that no label knows are learned from, marks of 0 add nothing, and the pool's condition holds."""
    docs = spark.createDataFrame([(i, "vile slur" if i < 40 else "kind flower") for i in range(400)], "doc_id long, text string")
    marks = [(i, 1) for i in range(20)]
    plain = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), prior=0.1, bags=1)
    more = toxicity.fit(docs, spark.createDataFrame(marks + [(i, 0) for i in range(300, 400)], "doc_id long, toxic int"), prior=0.1, bags=1)
    assert plain == more and plain[0][0]["vile"] > 0
    assert toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.col("doc_id") < 40, prior=0.1, bags=1)[0][0] == {}


def test_odd_rows(spark):
    docs = [(i, f"vile curse {'slur' if i % 3 == 0 else 'kind flower'} text {i % 7}", "x", i) for i in range(60)] + [(100, None, None, None), (101, "", "x", 1), (None, "slur vile", "x", 1), (3, docs_text := "vile curse slur text 3", "x", 3), (102, "slur " * 40_000, "y", 2)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (5, None), (999, 1)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, score string, toxic long"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(df, marks).collect()
    assert len(out) == len(docs) and all(r["held_out"] is not None and r["score"] is not None for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1 and docs_text
    kept = toxicity.without_toxic(df, marks)
    assert kept.columns == df.columns and kept.filter("doc_id = 101").count() == 1
    assert toxicity.toxicity(df.limit(0), marks).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(df, marks.limit(0)).collect())
