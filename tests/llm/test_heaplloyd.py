"""Heap Lloyd against SQL and against Lloyd rounds that scan everything."""

import random

import numpy as np
import pytest

from gridloom.llm import heaplloyd

INPUT = "vec_id long, embedding array<float>, label int, CODE string, error int"


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(heaplloyd.op11_heap_lloyd(spark, sf_dir), heaplloyd.OP11_SQL) > 0


def plain(rows, parts, entries, rounds):
    """rows: (vec_id, list of ints). Codes, errors and codebooks by the plain way, in Python's integers."""
    width = max([len(v) for _, v in rows] + [1])
    size = -(-width // parts)
    rows = sorted(((i, v + [0] * (size * parts - len(v))) for i, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (away(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v in rows]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [cut(v, p) for (_, v), c in zip(rows, codes, strict=True) if c[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((i is None, i or 0, bytes(c).hex(), min(sum(away(cut(v, p), books[p][c[p]]) for p in range(parts)), 2**63 - 1)) for (i, v), c in zip(rows, codes, strict=True)), books


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds", "spread"), [(300, 8, 4, 7, 3, 20), (40, 6, 4, 64, 2, 3), (5, 3, 2, 64, 2, 1000), (120, 4, 2, 5, 2, 2**36), (60, 4, 4, 6, 2, 2**62), (80, 4, 2, 1, 2, 9), (50, 4, 2, 6, 0, 9)])
def test_codes_against_plain_lloyd(spark, n, width, parts, entries, rounds, spread):
    random.seed(n)
    rows = [(random.randrange(n), [random.randrange(-spread, spread) for _ in range(random.choice([width, width, width - 1]))], 1) for _ in range(n)]
    rows += [(None, [0] * width, None), (n, [], None), *[(n + 1 + i, [spread - 1] * width, 2) for i in range(n // 3)]]  # a third are one vector
    got = heaplloyd.fit(spark.createDataFrame(rows, "vec_id long, v array<long>, label int").repartition(3), parts, entries, rounds)
    want, books = plain([r[:2] for r in rows], parts, entries, rounds)
    assert got.books.tolist() == books
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"]) for r in got.rows.collect()) == want


def test_only_violated_heaps_are_touched():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (200, 2)) + c for c in ((0, 0), (1000, 0), (0, 1000))])
    shape, book = heaplloyd.Shape(1, 2, 1100), np.array([[[0, 0], [1000, 0], [0, 1000]]], object)
    block = heaplloyd.Block(shape, 3, x)
    block.build(book)
    drift = heaplloyd._drift(book, book + 1)
    assert not len(block.violated(drift)) and block.settle(book + 1, drift) == []
    moved = book.copy()
    moved[0, 0] = [700, 0]
    drift += heaplloyd._drift(book + 1, moved)
    before = block.codes.copy()
    changed = block.settle(moved, drift)
    assert sum(len(rows) for _, rows, _ in changed) == 0 or (block.codes != before).any()
    assert (block.codes[:, 0] == heaplloyd.Shape(1, 2, 1100).scan(x, moved[0])[0]).all()
    back = heaplloyd.Block.read(shape, 3, len(x), block.stored())
    assert (back.codes == block.codes).all() and (back.keys == block.keys).all() and len(block.rows) == len(x)
    for i in range(3):  # every heap is one
        keys = back.keys[back.starts[i] : back.starts[i + 1]]
        assert all(keys[(j - 1) // 2] <= keys[j] for j in range(1, len(keys)))


def test_query_drops_odd_vectors_and_adds_up_labels(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), 1.0, -0.5, 0.25], i % 3 if i % 4 else None, "x", 1) for i in range(90)]
    rows += [(200, None, 1, "x", 1), (201, [1.0, None], 1, "x", 1), (202, [nan, 1.0], 1, "x", 1), (203, [inf, 1.0], 1, "x", 1)]
    spark.createDataFrame(rows, INPUT).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = heaplloyd.op11_heap_lloyd(spark, str(tmp_path)).collect()
    labels = {r[0]: r[2] for r in rows}
    assert sorted(r["vec_id"] for r in out) == list(range(90)) and len({r["codebooks_sha256"] for r in out}) == 1
    for r in out:
        assert r["label_error"] == sum(x["error"] for x in out if labels[x["vec_id"]] == labels[r["vec_id"]])
    spark.createDataFrame(rows[-4:], INPUT).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert heaplloyd.op11_heap_lloyd(spark, f"{tmp_path}/none").count() == 0
