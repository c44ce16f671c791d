"""Sketches: plain edits and neighbours, and estimates against exact containment."""

import hashlib
import random

from pyspark.sql import functions as F

from gridloom.llm import sketches


def plain(rows):
    """doc_id to edited text's hash and length, by order of doc_id (nulls first)."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for n, (i, t) in enumerate(rows):
        half, other = len(t) // 2, rows[(n + 1) % len(rows)][1]
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest())
    return out


def test_whole_table(spark, sf_dir):
    rows = sketches.op6_scaled_sketches(spark, sf_dir).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == plain(texts) and len(rows) == len(texts)
    of = dict(texts)
    by_text = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(of[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def exact_containment(a, b, words=5):
    shingles = lambda t: {tuple(w[i : i + words]) for w in [t.lower().split()] for i in range(len(w) - words + 1)}
    x, y = shingles(a), shingles(b)
    return len(x & y) / min(len(x), len(y))


def test_estimates(spark):
    random.seed(2)
    draw = lambda n: " ".join(f"w{random.randrange(5000)}" for _ in range(n))
    pairs = []
    for share in (0, 0.2, 0.5, 0.9, 1):
        for n, m in ((100, 100), (90, 8000), (3000, 3000), (6000, 40_000)):
            a = draw(n)
            cut = a.split()[: int(n * share)]
            pairs.append((a, " ".join(cut) + " " + draw(m)))
    pairs.append((draw(10), ""))
    pairs[-1] = (pairs[-1][0], draw(150) + " " + pairs[-1][0] + " " + draw(150))  # ten words, wholly contained
    df = spark.createDataFrame(pairs, "a string, b string")
    both = sketches.with_sketch(sketches.with_sketch(df, "a", "x"), "b", "y").withColumn("ab", F.concat_ws(" ", "a", "b"))
    rows = both.select("a", "b", "x", "y", sketches.likeness("x", "y").alias("likeness"), sketches.merge("x", "y").alias("m"), sketches.containment("x", "y").alias("contained")).collect()
    for r in rows:
        assert abs(r["likeness"] - exact_containment(r["a"], r["b"])) < 0.2
        assert r["m"] == sorted({*r["x"], *r["y"]}) and 0 <= r["contained"] <= 1
    assert rows[-1]["likeness"] == 1.0


def test_sketch_of_a_union(spark):
    random.seed(3)
    a, b = (" ".join(f"w{random.randrange(90)}" for _ in range(n)) for n in (60, 400))
    df = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, ab string")
    for c, out in (("a", "x"), ("b", "y"), ("ab", "z")):
        df = sketches.with_sketch(df, c, out, words=1)
    r = df.select("z", sketches.merge("x", "y").alias("m")).first()
    assert r["m"] == r["z"] and 20 < len(r["z"]) < 70


def test_likeness_of_whole_tables_is_near_the_truth(spark, sf_dir):
    """near_edited and near_next against exact containment of every document's shingles."""
    rows = {r["doc_id"]: r for r in sketches.op6_scaled_sketches(spark, sf_dir).collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    off = []
    for n, (i, t) in enumerate(texts):
        other = texts[(n + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        for want, got in ((edited, rows[i]["near_edited"]), (other, rows[i]["near_next"])):
            if min(len(t.split()), len(want.split())) >= 40:
                off.append(abs(exact_containment(t, want) - got))
    assert len(off) > 100 and sum(off) / len(off) < 0.05 and max(off) < 0.3


def test_odd_rows(spark):
    rows = [(None, "null id", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (3, "a b", "x", 1), (3, "a b", "x", 1), (4, "x y z " * 60_000, "x", 1), (5, "é👍" * 3, None, None)]
    rows += [(None, f"more {i}", None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string, range long")
    out = sketches.edited_fingerprints(df).collect()
    assert len(out) == len(rows)
    order = sorted((r["tie"], r["text"]) for r in df.filter("doc_id is null").selectExpr("xxhash64(text) tie", "text").collect())
    want = plain([(None, t) for _, t in order] + [(i, t) for i, t, _, _ in rows if i is not None])
    assert all((r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]] for r in out if r["doc_id"] not in (3, None))
    nulls = plain([(n, t) for n, (_, t) in enumerate([*order, (0, "")])])
    assert sorted(r["edited_sha256"] for r in out if r["doc_id"] is None) == sorted(nulls[n][1] for n in range(len(order)))
    assert sketches.edited_fingerprints(df.limit(0)).count() == 0
    assert [r["near_next"] for r in sketches.edited_fingerprints(df.filter("doc_id = 5")).collect()] == [1.0]
