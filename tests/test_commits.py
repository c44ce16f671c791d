"""Committed tables: merges by month, a crash, two writers, cleaning."""

import datetime
import os

import pytest

from gridloom.sources.commits import CommittedTable, Conflict

SCHEMA = "zone string, ts timestamp, p double, month string"


def rows(spark, *told):
    return spark.createDataFrame([(z, t and datetime.datetime(2024, *t), p, "x") for z, t, p in told], SCHEMA)


def held(table, number=None):
    return {(r["zone"], r["ts"] and (r["ts"].month, r["ts"].day)): r["p"] for r in table.load(number).collect()}


def files(path, part):
    folder = f"{path}/{part}"
    return {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder)}


def test_merges_touch_only_their_months(spark, tmp_path):
    path = str(tmp_path / "t")
    table = CommittedTable(spark, path, ["zone", "ts"])
    assert table.load() is None and table.versions() == []
    assert table.merge(rows(spark, ("a", (1, 5), 1.0), ("a", (2, 5), 2.0), ("b", (2, 6), 3.0), (None, None, 9.0))) == 1
    before = table.version()
    january = files(path, before.parts["2024-01"])
    assert table.merge(rows(spark, ("a", (2, 5), 20.0), ("a", (3, 1), 4.0))) == 2
    after = table.version()
    assert after.parts["2024-01"] == before.parts["2024-01"] and files(path, after.parts["2024-01"]) == january
    assert after.parts["2024-02"] != before.parts["2024-02"] and set(after.parts) == {"2024-01", "2024-02", "2024-03", "none"}
    assert held(table) == {("a", (1, 5)): 1.0, ("a", (2, 5)): 20.0, ("b", (2, 6)): 3.0, ("a", (3, 1)): 4.0, (None, None): 9.0}
    assert held(table, 1)["a", (2, 5)] == 2.0 and table.load().columns == ["zone", "ts", "p", "month"]
    assert table.merge(rows(spark).limit(0)) == 2 and table.drop_before("2024-03") == 3
    assert set(held(table)) == {("a", (3, 1)), (None, None)} and len(held(table, 2)) == 5


def test_a_crash_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = CommittedTable(spark, path, ["zone", "ts"])
    table.merge(rows(spark, ("a", (1, 5), 1.0)))
    monkeypatch.setattr(CommittedTable, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.merge(rows(spark, ("a", (1, 5), 7.0)))
    monkeypatch.undo()
    again = CommittedTable(spark, path, ["zone", "ts"])
    assert held(again) == {("a", (1, 5)): 1.0}
    assert again.merge(rows(spark, ("a", (1, 6), 2.0))) == 2 and held(again) == {("a", (1, 5)): 1.0, ("a", (1, 6)): 2.0}
    assert len(os.listdir(f"{path}/data")) - sum(f.endswith(".crc") for f in os.listdir(f"{path}/data")) == 3
    assert again.clean(1, 3600) == []  # too fresh: its writer might be alive
    assert len(again.clean(1, 0)) == 2 and held(again) == {("a", (1, 5)): 1.0, ("a", (1, 6)): 2.0} and again.versions() == [2]


@pytest.mark.parametrize(("other", "rewritten"), [((1, 9), True), ((5, 9), False)])
def test_two_writers(spark, tmp_path, monkeypatch, other, rewritten):
    path = str(tmp_path / "t")
    CommittedTable(spark, path, ["zone", "ts"]).merge(rows(spark, ("a", (1, 5), 1.0)))
    put, writes, first = CommittedTable.put, [], []

    def late(self, version):
        if not first:
            first.append(1)
            CommittedTable(spark, path, ["zone", "ts"]).merge(rows(spark, ("b", other, 5.0)))  # another one commits in between
        return put(self, version)

    write = CommittedTable._write
    monkeypatch.setattr(CommittedTable, "put", late)
    monkeypatch.setattr(CommittedTable, "_write", lambda self, df: writes.append(1) or write(self, df))
    table = CommittedTable(spark, path, ["zone", "ts"])
    assert table.merge(rows(spark, ("a", (1, 6), 2.0))) == 3
    assert held(table) == {("a", (1, 5)): 1.0, ("a", (1, 6)): 2.0, ("b", other): 5.0} and held(table, 2) == {("a", (1, 5)): 1.0, ("b", other): 5.0}
    assert len(writes) == (3 if rewritten else 2)
    monkeypatch.setattr(CommittedTable, "put", lambda *_: False)
    with pytest.raises(Conflict):
        table.merge(rows(spark, ("a", (1, 7), 3.0)), tries=2)
