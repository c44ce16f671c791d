"""The corpus pipeline: from documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again.

All stages take any further columns along, whatever their names. A null text counts as empty: it isn't toxic, empty texts are copies
of each other, and an empty text becomes a piece of one end token. Rows without a doc_id pass all stages and are pieces of a null
doc_id; those that repeat a doc_id are told apart by their texts. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import mixing, nearcopies, packing, secrets, toxicity
from gridloom.llm.scratch import Scratch, released


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers don't call toxic; they learn from the labelled ones among them."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id: 5-word shingles, likeness 0.8 or more."""
    return nearcopies.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked in their texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as their sources' target rates ask, in a shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Trained classifiers, XXH64 and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the last one's rows. A stage's own tables, and its input, go once its output is written."""
    scratch, docs, last = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if last:
            scratch.drop(last)
        last = name.replace(" ", "_")
    return STAGES[-1][1](spark, docs, sf_dir)
