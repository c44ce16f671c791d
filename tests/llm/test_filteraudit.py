"""Filter audit against SQL and against a walk of every document through every order."""

from collections import Counter
from itertools import permutations

import pytest

from gridloom.llm import filteraudit

DOCS = "doc_id long, text string, lang string, source string, TEXT_key string, mask int"


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(filteraudit.op12_filter_audit(spark, sf_dir), filteraudit.OP12_SQL) > 0


def test_text_mask():
    many = " ".join(f"w{i}" for i in range(200))
    assert filteraudit.text_mask(many) == 0 and filteraudit.text_mask(many[:-4]) == 1
    assert filteraudit.text_mask("") == 1
    assert filteraudit.text_mask(" ".join(["a", "b", "c"] * 100)) == 2
    # a no-break space parts no words; words that differ in case alone are two
    assert filteraudit.text_mask(" ".join(map(str, range(300)))) == 1
    assert filteraudit.text_mask("a A " + "b c d e f g " * 40) & 2
    # three capitals of 100 code points are allowed, multi-byte ones count once
    assert not filteraudit.text_mask("ABC" + "é" * 97) & 4 and filteraudit.text_mask("ABC" + "é" * 96) & 4
    assert filteraudit.text_mask("x|y") & 8 and not filteraudit.text_mask("x!y") & 8


def rows():
    long = " ".join(f"w{i}" for i in range(250))
    out = [(i, f"same text {i % 3}", "en", "s", "x", 7) for i in range(40)]
    out += [(100, long, "de", "s", "x", 7), (101, long, None, "s", "x", 7), (101, long, "", "s", "x", 7), (102, long + " $", "de", "s", "x", 7)]
    out += [(None, long, "fr", "s", "x", 7), (None, long, "fr", "s", "x", 7), (103, None, "fr", "s", "x", 7), (104, "", "fr", "s", "x", 7)]
    return out + [(105, "NOISE " * 20_000, "fr", "s", "x", 7), (100, long, "de", "s", "x", 7)]


def test_orders_against_a_walk(spark):
    docs, marks = rows(), [(3, 1, 0), (3, 0, 1), (100, 1, 1), (105, None, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filteraudit.audit(filteraudit.masks(spark.createDataFrame(docs, DOCS), labels)).collect()}
    good, toxic = {3, 100}, {3, 100, 105}
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    told = [(lang or "", {"ABCD"[b] for b in range(4) if filteraudit.text_mask(text or "") >> b & 1} | ({"E"} if i is not None and i > first[text or ""] else set()), i) for i, text, lang, *_ in docs]
    want, total = Counter(), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, fails, i in told:
            gone = min((order.index(f) for f in fails), default=9)
            for step, letter in enumerate(order):
                key = (part, order, step + 1)
                want[*key, "kept"] += gone > step
                want[*key, "removed"] += gone == step
                want[*key, "redundant"] += letter in fails and gone < step
                want[*key, "unique_fails"] += fails == {letter}
                want[*key, "good_lost"] += gone == step and i in good
                want[*key, "toxic_lost"] += gone == step and i in toxic
                total[part, letter] += gone == step
    assert len(got) == 120 * 5 * 4
    for (part, order, step), r in got.items():
        assert r["shapley"] == total[part, order[step - 1]]
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[part, order, step, name]


def test_other_filters_and_empty_tables(spark):
    masked = spark.createDataFrame([("p", 0, 0, 0), ("p", 1, 1, 0), ("p", 3, 0, 1), ("p", 2, 0, 0)], "part string, mask int, good int, toxic int")
    out = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filteraudit.audit(masked, "XY").collect()}
    assert out == {("XY", 1): (2, 2, 0, 3), ("XY", 2): (1, 1, 1, 3), ("YX", 1): (2, 2, 0, 3), ("YX", 2): (1, 1, 1, 3)}
    assert filteraudit.audit(masked.limit(0)).count() == 0
    docs = spark.createDataFrame([], DOCS)
    assert filteraudit.audit(filteraudit.masks(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    with pytest.raises(ValueError):
        filteraudit.audit(masked, "")
