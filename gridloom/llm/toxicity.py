"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts that labels mark as toxic; the unlabelled are documents at large, drawn without regard to any label, in which
toxic ones hide at the class prior. The texts of rows that labels mark as not toxic have no part of their own. The prior is a
parameter; where none is given, it is the share of toxic marks among the labelled rows. A classifier minimises p R+(f) + max(0, Ru-(f) - p R+-(f)): the risk on positives as
positives, and on the unlabelled as negatives less what the positives among them must cost. The last part is kept from
going below zero, or the classifier would learn the positives by heart.

Features are words and their beginnings (4 to 6 letters). For each classifier, the ones seen in positives far more often than
in the unlabelled are its vocabulary. Classifiers are numpy logistic models, one per hash-dealt bag of the
training rows, each trained in one task; a document's score is the mean of their probabilities.

Bounds: at most about ``positives`` and ``unlabelled`` training texts (hash-sampled to those expected counts), of which a bag
holds a part; the models that are sent to the tasks hold ``vocabulary`` words each. All documents are scored, each by its
whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import fresh_name

_WORD = re.compile(r"[^\W\d_]+")
#: Distinct words whose features a worker remembers; beyond it starts anew.
WORDS_KEPT = 300_000


def word_features(word: str) -> tuple[str, ...]:
    """A word in lower case and its beginnings."""
    return (word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) > k))


def features(text: str) -> set[str]:
    """The features of a text, each once."""
    return {f for word in set(_WORD.findall(text.lower())) for f in word_features(word)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def numbered(texts: Iterable[str], names: dict[str, int]) -> list[np.ndarray]:
    """The features of texts by number; names gains the new ones."""
    return [np.fromiter((names.setdefault(f, len(names)) for f in features(x)), np.int32) for x in texts]


def choose(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: dict[str, int], most: int) -> list[str]:
    """Features of at least 5 positives with the largest gain p log(p / u), p and u their shares in either set."""
    count = lambda rows: np.bincount(np.concatenate(rows), minlength=len(names)) if rows else np.zeros(len(names))
    n, p, u = count(positive), count(positive) / len(positive), (count(unlabelled) + 0.5) / (len(unlabelled) + 1)
    gain = np.where((n >= 5) & (p > 1.5 * u), p * np.log(np.maximum(p, 1e-12) / u), 0)
    best = np.flatnonzero(gain > 0)
    by_number = list(names)
    return sorted((by_number[i] for i in best.tolist()), key=lambda f: (-gain[names[f]], f))[:most]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk, by full-batch Adam from zero.

    With few positives their part of the risk is learned by heart and leaves room for false alarms. So the bias is lowered, where
    need be, until no larger share of the unlabelled than the prior is called toxic.
    """
    n = positive.shape[1]
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        a, b = sigmoid(positive @ w[:n].astype(np.float32) + w[n]), sigmoid(unlabelled @ w[:n].astype(np.float32) + w[n])
        # logistic losses: -log s as a positive, -log(1 - s) as a negative
        negative = -np.mean(np.log(1 - b + 1e-12)) - prior * -np.mean(np.log(1 - a + 1e-12))
        as_positive = prior * (a - 1) / len(a)
        as_negative_p, as_negative_u = -prior * a / len(a), b / len(b)
        if negative < 0:  # held at zero, it has no slope
            gp, gu = as_positive, np.zeros(len(b))
        else:
            gp, gu = as_positive + as_negative_p, as_negative_u
        g = np.concatenate((positive.T @ gp.astype(np.float32) + unlabelled.T @ gu.astype(np.float32) + decay * w[:n], [gp.sum() + gu.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = np.sort(unlabelled @ w[:n].astype(np.float32))[::-1]
    return w[:n], float(min(w[n], -z[int(prior * len(z))] - 1e-6))


def matrix(rows: list[np.ndarray], names: dict[str, int], words: list[str]) -> np.ndarray:
    """Which text has which word, 1 or 0."""
    at = np.full(len(names), -1)
    at[[names[w] for w in words]] = np.arange(len(words))
    out = np.zeros((len(rows), len(words)), np.float32)
    for row, found in enumerate(rows):
        columns = at[found]
        out[row, columns[columns >= 0]] = 1
    return out


def _bag_trainer(prior: float, vocabulary: int):
    def trained(key: tuple, table: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        rows = numbered((x.as_py() or "" for x in table.column("text")), names)
        positive = [x for x, y in zip(rows, table.column("toxic").to_pylist()) if y]
        unlabelled = [x for x, y in zip(rows, table.column("unlabelled").to_pylist()) if y]
        words = choose(positive, unlabelled, names, vocabulary) if positive and unlabelled else []
        if words:
            weights, bias = train(matrix(positive, names, words), matrix(unlabelled, names, words), prior)
        else:
            weights, bias = np.zeros(0), float(np.log(prior / (1 - prior)))
        out = {"bag": [key[0].as_py()], "words": [words], "weights": [weights.tolist()], "bias": [bias]}
        return pa.table(out, schema=pa.schema([("bag", pa.int32()), ("words", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())]))

    return trained


def fit(docs: DataFrame, labels: DataFrame, pool: Column | None = None, prior: float | None = None, positives: int = 3_000, unlabelled: int = 8_000, bags: int = 5, vocabulary: int = 512, seed: int = 42) -> list[tuple[dict[str, float], float]]:
    """One (weights by feature, bias) per bag. labels: doc_id and toxic of the rows to learn from, no others.

    The unlabelled are drawn by a hash from all docs that meet the condition ``pool`` on doc_id (all, if it is None), whether labels
    know them or not. Rows with a null doc_id or a null mark are left out; a doc_id that labels marks twice counts as toxic
    if either does. Without a positive row every text gets the prior (at least 0.001) as its score. A training row goes to
    all bags but one, so that each bag misses another part.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, hits = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(hits / max(n, 1) if prior is None else prior, 0.001), 0.999)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    drawn = pool if pool is not None else F.lit(True)
    steps, at = 1 << 20, F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    positive = marks.filter((F.col("toxic") == 1) & (at < positives / max(hits, 1) * steps)).select("doc_id", F.lit(True).alias("toxic"))
    as_unlabelled = drawn & (at < unlabelled / max(rows.filter(drawn).count(), 1) * steps)
    # the positives are bounded by their parameter, so they may go to every task
    sample = rows.join(F.broadcast(positive), "doc_id", "left").select("doc_id", "text", F.coalesce("toxic", F.lit(False)).alias("toxic"), as_unlabelled.alias("unlabelled"))
    bag = F.explode(F.array_remove(F.array(*[F.lit(x) for x in range(bags)]), F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(bags)).cast("int"))) if bags > 1 else F.lit(0)
    dealt = sample.filter(F.col("toxic") | F.col("unlabelled")).withColumn("bag", bag)
    models = dealt.groupBy("bag").applyInArrow(_bag_trainer(prior, vocabulary), "bag int, words array<string>, weights array<double>, bias double").collect()
    if not models:
        return [({}, float(np.log(prior / (1 - prior))))]
    return [(dict(zip(m["words"], m["weights"])), m["bias"]) for m in sorted(models, key=lambda m: m["bag"])]


def score(docs: DataFrame, models: list[tuple[dict[str, float], float]], out: str) -> DataFrame:
    """docs with a column of scores from 0 to 1; a null text counts as empty. All columns are kept."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = sorted({f for weights, _ in models for f in weights})
    at = {f: i for i, f in enumerate(names)}
    weights, biases = np.zeros((len(names) + 1, len(models))), np.array([b for _, b in models])
    for k, (known, _) in enumerate(models):
        weights[[at[f] for f in known], k] = list(known.values())
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            found = kept.get(word)
            if found is None:
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                found = kept[word] = tuple(at[f] for f in word_features(word) if f in at)
            return found

        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, value in enumerate(batch.column(text)):
                seen = {i for word in set(_WORD.findall((value.as_py() or "").lower())) for i in of(word)}
                scores[row] = sigmoid(weights[list(seen)].sum(axis=0) + biases).mean()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of doc_id as text leaves 0 modulo 5."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by classifiers that learn from rows not held out.

    Repeated rows each have their row, with the same score. A null doc_id is scored and not held out. An empty table
    gives an empty table. Other columns aren't read. Neither labels nor texts of held-out rows are learned from.
    """
    models = fit(docs, labels.filter(~held_out()), ~held_out(), **parameters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(rows, models, "score")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose score is under 0.5, as they are."""
    name = fresh_name(docs, "toxic_score")[0]
    return score(docs, fit(docs, labels.filter(~held_out()), ~held_out(), **parameters), name).filter(F.col(name) < 0.5).drop(name)


def op2_nnpu_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
