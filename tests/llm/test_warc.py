"""WARC archives: rows against SQL, and salvage of damaged bytes."""

import random
import zlib

from gridloom.llm import warc
from gridloom.llm.scratch import Scratch


def test_rows_against_sql(spark, sf_dir, same_rows):
    assert same_rows(warc.op3_warc_salvage(spark, sf_dir), warc.OP3_SQL) > 0


def records(n, seed=0):
    random.seed(seed)
    import hashlib

    out = []
    for i in range(n):
        payload = bytes(random.randrange(256) for _ in range(random.randrange(2000)))
        out.append((str(i), payload, warc.record("response", str(i), f"http://h/{i}", len(payload), hashlib.sha256(payload).hexdigest(), payload)))
    return out


def test_salvage_of_every_damaged_member():
    """Whatever member is damaged, all others are read, and the gaps tell the bytes lost."""
    made = records(12)
    members = [warc.member(r) for _, _, r in made]
    for broken in range(12):
        for kind in ("flip", "cut", "junk"):
            parts = list(members)
            middle = len(parts[broken]) // 2
            if kind == "flip":
                parts[broken] = parts[broken][:middle] + bytes([parts[broken][middle] ^ 255]) + parts[broken][middle + 1 :]
            elif kind == "cut":
                parts[broken] = parts[broken][:middle]
            else:
                parts[broken] = b"\x1f\x8b\x08 junk WARC/1.1\r\n" + parts[broken]
            rows = list(warc.salvage("f", b"".join(parts)))
            seen = {r[4] for r in rows if r[3] != "gap"}
            want = {i for i, _, _ in made} - ({str(broken)} if kind != "junk" else set())
            assert seen == want
            gaps = [r for r in rows if r[3] == "gap"]
            assert gaps and all(g[9] for g in gaps)
            spans = sorted({(r[1], r[2]) for r in rows})
            assert spans[0][0] == 0 and spans[-1][1] == sum(map(len, parts)) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_headers_of_a_damaged_stored_member_are_not_believed():
    made = records(3, 4)
    members = [zlib.compress(r, 0, wbits=31) for _, _, r in made]
    hurt = members[1].replace(b"WARC-X-Page-ID: 1", b"WARC-X-Page-ID: 7")
    rows = list(warc.salvage("f", members[0] + hurt + members[2]))
    assert [r[4] for r in rows] == ["0", None, "2"] and rows[1][3] == "gap"


def test_uncompressed_archives():
    made = records(8, 1)
    data = b"".join(r for _, _, r in made)
    assert [r[4] for r in warc.salvage("f", data)] == [i for i, _, _ in made]
    at = data.index(b"WARC-X-Page-ID: 3")
    hurt = data[: at - 60] + b"XX" + data[at - 58 :]
    rows = list(warc.salvage("f", hurt))
    assert {r[4] for r in rows if r[3] != "gap"} >= {i for i, _, _ in made} - {"3"}
    assert list(warc.salvage("f", b"")) == [] and [r[3] for r in warc.salvage("f", b"no archive")] == ["gap"]
    assert all(r[3] != "gap" for r in warc.salvage("f", zlib.compress(b"", wbits=31)))


def test_odd_rows(spark):
    big = "ß" * 9_000_000
    rows = [(5, "u\r\nx", "p" * 100, 1), (3, None, "p" * 100, 1), (3, None, "p" * 100, 1), (9, "u", "p" * 99, 2), (8, "u", "p" * 99, 2), (None, "u", "p" * 100, 3), (7, "u", None, 4), (6, "u", "", 5), (10, "u", big, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    path = Scratch(spark, "t").path("a")
    warc.write_archives(df, path)
    out = warc.read_archives(spark, path).collect()
    got = sorted((r["page_id"] or "", r["kind"], r["payload_bytes"], r["refers_to"]) for r in out)
    assert got == sorted([("5", "revisit", 100, "3"), ("3", "response", 100, None), ("3", "response", 100, None), ("9", "response", 99, None), ("8", "response", 99, None), ("", "revisit", 100, "3"), ("7", "response", 0, None), ("6", "response", 0, None), ("10", "response", 18_000_000, None)])
    path = Scratch(spark, "t").path("b")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_salvage_inside_a_member():
    """A member of several records loses only the bad one, or what was behind the cut."""
    import gzip

    made = [r for _, _, r in records(9, 7)]
    bad = made[4][:-10] + bytes([made[4][-10] ^ 255]) + made[4][-9:]
    rows = list(warc.salvage("f", gzip.compress(b"".join([*made[:4], bad, *made[5:]])) + warc.member(made[0])))
    assert [r[4] for r in rows] == ["0", "1", "2", "3", None, "5", "6", "7", "8", "0"]
    at = sum(map(len, made[:4]))
    assert rows[4][3] == "gap" and f"bytes {at} to {at + len(bad)}: payload digest differs" in rows[4][9]
    whole = gzip.compress(b"".join(made))
    rows = list(warc.salvage("f", whole[: len(whole) * 2 // 3]))
    seen = [r[4] for r in rows if r[3] != "gap"]
    assert seen == [str(i) for i in range(len(seen))] and 4 <= len(seen) < 9 and any(r[9] == "member without end" for r in rows)
    stored = zlib.compress(b"".join(made), 0, wbits=31)
    at = stored.index(made[4][-60:-20])
    rows = list(warc.salvage("f", stored[:at] + bytes([stored[at] ^ 255]) + stored[at + 1 :]))
    assert {r[4] for r in rows if r[3] != "gap"} == {str(i) for i in range(9) if i != 4}


def test_archives_of_any_name_and_in_subfolders(spark, tmp_path):
    made = [r for _, _, r in records(3, 2)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "crawl-0001.warc.gz").write_bytes(warc.member(made[0]))
    (tmp_path / "deep" / "crawl-0002.warc.gz").write_bytes(warc.member(made[1]))
    (tmp_path / "deep" / "plain.warc").write_bytes(made[2])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    assert sorted(r["page_id"] for r in warc.read_archives(spark, str(tmp_path)).collect()) == ["0", "1", "2"]


def test_archives_are_bounded_by_bytes(spark):
    """Many small archives give the same rows as one; a payload that most pages share is told by ids and digests alone."""
    rows = [(i, f"u{i}", ("shared " * 40) if i % 3 else f"own {i} " * 30) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = []
    for size in (2_000, 1 << 28):
        path = Scratch(spark, "t").path("sizes")
        warc.write_archives(df, path, archive_bytes=size)
        out = warc.read_archives(spark, path)
        found.append(sorted((r["page_id"], r["kind"], r["payload_digest"], r["refers_to"] or "") for r in out.collect()))
        lengths = [r["length"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()]
        assert max(lengths) < size + 2_000
    assert found[0] == found[1] and sum(r[1] == "revisit" for r in found[0]) == 199


def test_gaps_are_kept_in_a_table(spark, tmp_path):
    made = [warc.member(r) for _, _, r in records(3, 9)]
    (tmp_path / "a.warc.gz").write_bytes(made[0] + b"lost bytes" + made[1])
    good, gaps = warc.page_records(spark, str(tmp_path), Scratch(spark, "t"))
    assert good.count() == 2 and [(r["start"], r["end"]) for r in gaps.collect()] == [(len(made[0]), len(made[0]) + 10)]
