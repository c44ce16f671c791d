"""Near copies against exact likeness of all pairs."""

import random
from collections import defaultdict

import pytest

from gridloom.llm import nearcopies
from gridloom.llm.scratch import Scratch


def plain_set(text, words=5):
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    return {" ".join(found[i : i + words]) for i in range(len(found) - words + 1)} or ({" ".join(found)} if found else set())


def plain_components(texts, least=0.8):
    """Position to the smallest position reachable, over all pairs that share a shingle or are both empty."""
    sets, root, held = [plain_set(t) for t in texts], list(range(len(texts))), defaultdict(list)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s or {None}:
            for j in held[x]:
                shared[j] += 1
            held[x].append(i)
        for j, n in shared.items():
            if not s or n / (len(s) + len(sets[j]) - n) >= least:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


def changed(words, n, mark):
    """words with n of them replaced, 5 or more places apart so that each costs five shingles."""
    return [f"{mark}{i}" if i % 7 == 3 and i // 7 < n else w for i, w in enumerate(words)]


def planted():
    random.seed(3)
    texts = []
    for g in range(30):
        base = [f"g{g}w{random.randrange(500)}" for _ in range(160)]
        texts += [" ".join(changed(base, n, f"m{g}x{n}")) for n in (0, 1, 2, 3, 4, 6)]
    return texts


@pytest.mark.parametrize("block_rows", [512, 7])
def test_groups_against_all_pairs(spark, block_rows):
    texts = planted() + ["", None, " \n", "one two", "ONE two", "one three"]
    crowd = [f"c{i}" for i in range(200)]  # a chain: each alike to the next, the ends not
    for k in range(40):
        crowd = crowd[6:] + [f"d{k}e{i}" for i in range(6)]
        texts.append(" ".join(crowd))
    scratch = Scratch(spark, "test")
    rows = scratch.keep(spark.createDataFrame(list(enumerate(texts)), "rid long, text string"), "rows")
    got = {r["rid"]: r["component"] for r in nearcopies.groups(rows, ["rid"], scratch, block_rows=block_rows).collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == plain_components(texts)


def test_stage_against_all_pairs(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = sorted(((r["doc_id"], r["text"]) for r in docs.collect()))
    held += [(1_000_000 + i, t) for i, t in enumerate(planted())]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(held[-180:], "doc_id long, text string"))
    want = sorted({held[i][0] for i in plain_components([t for _, t in held])})
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, given, sf_dir).collect()) == want


def test_repeated_and_null_doc_ids(spark):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(4, "one text of five words"), (4, "another text of five words"), (2, long), (7, long + " end"), (7, "third"), (None, long), (None, long), (7, "third")]
    kept = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(4, "one text of five words"), (4, "another text of five words"), (2, long), (7, "third"), (None, long), (None, long)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    assert nearcopies.one_of_each(kept.limit(0)).count() == 0
