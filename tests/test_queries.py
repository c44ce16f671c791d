"""Every query of the library against its SQL, and the learners against plain Python."""

import random

import pytest

from gridloom.plans import catalog
from gridloom.streaming import online


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_rows_against_sql(name, spark, larger_dir, same_rows_larger):
    assert same_rows_larger(catalog.QUERIES[name](spark, larger_dir), catalog.ORACLE_SQL[name]) > 0


def test_conformal_coverage(spark, larger_dir):
    out = catalog.QUERIES["conformal_fold"](spark, larger_dir).toPandas()
    settled = out[out["upper"] > out["lower"]]
    assert len(settled) and abs(settled["hit"].mean() - 0.9) < 0.04


def test_bias_stream_gives_the_folds_state(spark, tmp_path):
    random.seed(1)
    rows = [(h, f"2024-01-{d:02d} 00:00:00", random.uniform(0, 50) + (400 if d == 9 else 0), 20.0) for h in range(3) for d in range(1, 15)]
    df = spark.createDataFrame(rows, "hour long, ts string, actual double, pred double").selectExpr("hour", "cast(ts as timestamp) as ts", "actual", "pred")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = online.bias_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "hour")
    running = stream.writeStream.outputMode("update").format("memory").queryName("bias").trigger(availableNow=True).start()
    running.awaitTermination(120)
    got = {r["hour"]: (r["bias"], r["spread"], r["n"]) for r in spark.table("bias").collect()}
    want = {r["hour"]: (r["bias"], r["spread"], r["n"]) for r in online.bias_fold(df, ["hour"]).collect()}
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in got)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["ts", "seasonal", "linear", "decay", "mean"] and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
