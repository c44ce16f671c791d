"""Shared folders, tables that go with their operator call, and joins with frequent keys."""

from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import pytest

from gridloom.llm.keeping import join_by_key
from gridloom.llm.scratch import Scratch, released, shared_folder


def test_a_cluster_needs_a_named_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(bare)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "hdfs://shared"), sparkContext=context)
    assert shared_folder(named) == "hdfs://shared"


def there(scratch):
    return Path(scratch.root.removeprefix("file:")).exists()


def test_tables_go_with_their_call(spark):
    with released():
        with released():
            inner, lasting = Scratch(spark, "inner"), Scratch(spark, "lasting", lasting=True)
            inner.keep(spark.range(3), "t")
            held = lasting.keep(spark.range(4), "t")
        assert not there(inner) and held.count() == 4
    assert not there(lasting)


def test_join_by_key_with_a_frequent_key(spark):
    rows = [(7 if i % 3 == 0 else i, f"v{i}") for i in range(3000)] + [(None, "none")]
    df = spark.createDataFrame(rows, "k long, frequent string")
    groups = Scratch(spark, "test").keep(df.groupBy("k").count().selectExpr("k", "k * 10 as told", "count as n"), "groups")
    got = Counter((r["k"], r["frequent"], r["told"]) for r in join_by_key(df, groups, "k", "n").collect())
    assert got == Counter((k, v, 10 * k) for k, v in rows if k is not None)
    assert join_by_key(df.limit(0), groups.limit(0), "k", "n").count() == 0
