"""Line dedup against SQL and a plain count of lines; runs against plain sets."""

import random
from collections import Counter

from gridloom.llm import linededup
from gridloom.llm.scratch import Scratch


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(linededup.op13_line_dedup(spark, sf_dir), linededup.OP13_SQL) > 0


def plain_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def plain(texts, least):
    seen = Counter(k for t in texts for k in {plain_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[plain_key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    return out


def planted():
    random.seed(3)
    pool = ["Common line", " common LINE\t", "Ünïcode ÄÖ", "ünïcode ÄÖ", " no-break ", "x", "", "  ", "\x0bv\r"]
    texts = ["\n".join(random.choice([*pool, f"own {i} {j}"]) for j in range(random.randrange(1, 12))) for i in range(60)]
    return [*texts, None, "", "\n\n", "common line", "twice\ntwice\ntwice", "\n".join(["x"] * 5000), "y" * 300_000]


def test_dropped_against_a_plain_count(spark):
    texts = planted()
    rows = [(i % 50 if i % 7 else None, t, "en", i) for i, t in enumerate(texts)] + [(1, "twin\ncommon line", "en", 900), (1, "twin\ncommon line", "en", 901)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_LINES string, row_h int")
    for least, batches in ((2, 1), (4, 3), (10, 5)):
        out = linededup.drop_common_lines(docs, least, batches)
        assert out.columns == ["doc_id", "text", "N_LINES", "row_h", "_n_lines", "n_dropped"]
        got = {r["row_h"]: (r["_n_lines"], r["n_dropped"], r["text"]) for r in out.collect()}
        assert got == dict(zip([r[3] for r in rows], plain([r[1] for r in rows], least), strict=True))
    assert linededup.drop_common_lines(docs.limit(0)).count() == 0


def test_runs_are_levelled_and_know_common_lines(spark):
    random.seed(5)
    batches = [[(random.randrange(-40, 40), 1) for _ in range(150)] for _ in range(7)]
    runs = linededup.LineRuns(spark, Scratch(spark, "runs").root, 9, buckets=4)
    total = Counter()
    for n, batch in enumerate(batches, 1):
        before = {k for name in runs.runs() for k in map(tuple, spark.table(name).filter("docs >= 9").select("h", "g").collect())}
        frame = spark.createDataFrame(batch, "h long, g long")
        told = runs.without_common(frame.distinct())
        assert set(map(tuple, told.collect())) == set(batch) - before
        runs.add(frame)
        total.update(batch)
        assert [len(level) for level in runs.levels] == [n >> k & 1 for k in range(len(runs.levels))]  # a binary count of batches
    # a run's side of the anti join is read in its buckets, without an exchange
    plan = runs.without_common(spark.createDataFrame(batches[0], "h long, g long").repartition(4, "h", "g"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    assert {(r["h"], r["g"]) for r in runs.common().collect()} == {k for k, n in total.items() if n >= 9}
    assert all(r["docs"] <= total[r["h"], r["g"]] for r in runs.common().collect())
    runs.release()
    assert runs.common().count() == 0
