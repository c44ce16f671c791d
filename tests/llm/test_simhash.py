"""Fingerprints and groups against a plain per-text, all-pairs version."""

import random

import pytest
import xxhash

from gridloom.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node long"


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, most=2):
    """doc_id to smallest reachable doc_id, over all pairs."""
    ids = list(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= most and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = simhash.op4_simhash_near_dedup(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_groups(prints)
    assert len(rows) == len(texts)


def test_links_over_chains_and_full_buckets(spark):
    """Fingerprints in crowds, deeper than one bucket holds: same groups as all pairs."""
    random.seed(5)
    prints, centre = set(), [random.getrandbits(64) for _ in range(4)]
    for c in centre:
        for _ in range(120):
            x = c
            for b in random.sample(range(64), random.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    from gridloom.llm.components import components
    from gridloom.llm.scratch import Scratch

    scratch = Scratch(spark, "test")
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    distinct = scratch.keep(spark.createDataFrame(signed, "fp long"), "d")
    roots = {r["node"]: r["root"] for r in components(simhash.links(distinct, scratch, bucket_rows=48), scratch).collect()}
    plain = plain_groups({p[0]: p[0] & (1 << 64) - 1 for p in signed})
    for p in plain:
        assert roots.get(p, p) == plain[p]


@pytest.mark.parametrize("most", [1, 3])
def test_other_distances(spark, most):
    random.seed(most)
    base = random.getrandbits(62)
    values = [base] + [base ^ sum(1 << b for b in random.sample(range(62), k)) for k in (1, 2, 3, 4, 5) for _ in range(12)]
    from gridloom.llm.components import components
    from gridloom.llm.scratch import Scratch

    scratch = Scratch(spark, "test")
    distinct = scratch.keep(spark.createDataFrame([(v,) for v in set(values)], "fp long"), "d")
    roots = {r["node"]: r["root"] for r in components(simhash.links(distinct, scratch, most=most, bucket_rows=24), scratch).collect()}
    plain = plain_groups({v: v for v in set(values)}, most)
    assert {v: roots.get(v, v) for v in plain} == plain


def test_odd_rows(spark):
    long = "a b c d e f g " * 30_000
    rows = [(1, None, "x", 9), (2, "", "x", 9), (3, " \n\t", None, None), (4, long, "x", 1), (4, long, "x", 1), (None, "one two", "y", 2), (6, "ONE two", "y", 2), (7, "Été", "y", 3)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"]): r for r in out}
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[1]["fingerprint"] == "0" * 16
    assert by[None]["component_id"] == 6 and by[4]["component_id"] == 4
    assert by[7]["fingerprint"] == f"{plain_fingerprint('Été'):016x}"
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each(spark):
    rows = [(5, "a b c d", "p", 1), (3, "a b c d", "q", 2), (3, "a b c d", "q", 2), (9, "other words here now", "r", 3), (None, "a b c d", "s", 4)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "node"]
    assert sorted((r["doc_id"] or 0, r["fp"]) for r in kept.collect()) == [(0, "s"), (3, "q"), (9, "r")]


def test_one_of_each_where_doc_ids_repeat(spark):
    """A doc_id's rows stand for each other only within a component."""
    rows = [(4, "a b c d", "p", 1), (4, "other words here now", "q", 2), (2, "third text of words", "r", 3), (4, "third text of words", "s", 4)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["fp"] for r in kept.collect()) == ["p", "q", "r"]
