"""Packing: an exact round trip of token ids, and bounds against brute force."""

import random
import zlib
from array import array
from itertools import permutations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gridloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def held(rows, documents):
    """All that the contract asks of packed pieces."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == documents.keys()
    for doc_id, ids in documents.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // 1024)
        assert all(p["length"] == 1024 for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(array("I", ids[at : at + p["length"]]).tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    return len(by_sequence)


def test_round_trip_and_few_sequences(spark, sf_dir):
    documents = {r["doc_id"]: ids_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.op9_best_fit_packing(spark, sf_dir).collect()
    sequences = held(rows, documents)
    least = packing.least_bins(np.array([r["length"] for r in rows]), 1024)
    assert sequences <= least * 1.01 + 1
    told = packing.certificate(packing.op9_best_fit_packing(spark, sf_dir)).first()
    assert told["sequences"] == sequences and least <= told["least"] <= sequences and told["gap"] == sequences - told["least"]


def test_both_libraries_give_the_same_ids(spark, sf_dir):
    encode = packing.encoding(PATH)
    larger = sf_dir.replace("sf0.001", "sf0.01")
    texts = [r["text"] for folder in (sf_dir, larger) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()] + ["", " ", "<|endoftext|>", "a\u0000b", "été 漢字 👍🏽", "x" * 5000, "\n\n\n  \t"]
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    for text in texts:
        assert list(encode(text or "")) == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_bound_never_exceeds_the_optimum():
    random.seed(3)
    for _ in range(60):
        capacity = random.choice([10, 12, 17])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 6))]
        best = 99
        for order in set(permutations(lengths)):
            bins, gap = 0, 0
            for x in order:
                bins, gap = (bins, gap - x) if x <= gap else (bins + 1, capacity - x)
            best = min(best, bins)
        assert packing.least_bins(np.array(lengths), capacity) <= best
        bin_of, offset, filled = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert filled.max() <= capacity and len(filled) >= best and filled.sum() == sum(lengths)


def test_odd_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (2, "", 2), (None, "words here", 3), (4, "word " * 9_000, 4)]
    schema = "doc_id long, text string, length long"
    out = packing.pack_documents(spark.createDataFrame(rows, schema), PATH).collect()
    assert [r["length"] for r in out if r["doc_id"] == 1] == [1, 1]
    assert sum(r["length"] for r in out if r["doc_id"] == 4) == len(ids_of("word " * 9_000))
    assert sum(r["length"] for r in out if r["doc_id"] is None) == len(ids_of("words here"))
    assert packing.pack_documents(spark.createDataFrame([], schema), PATH).count() == 0
