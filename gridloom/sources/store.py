"""A store of hourly series: merges, windows, content hashes, manifests, problems, and versioned states.

A table's hash is a sum over its rows' hashes, so it depends neither on their order nor on how they are dealt, and one pass tells it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.names import fresh_name


def merged(stored: DataFrame, fresh: DataFrame, keys: list[str], fill: bool = False) -> DataFrame:
    """Stored and fresh rows by key, a fresh one in place of a stored one; of fresh rows with one key, the greatest.

    fill: where a fresh row has a null, the stored value stays.
    """
    values = [c for c in stored.columns if c not in keys]
    of = lambda df, rank: df.select(*keys, F.struct(F.lit(rank).alias("rank"), *values).alias("row"))
    both = of(stored, 0).unionByName(of(fresh.select(*stored.columns), 1)).groupBy(*keys).agg(F.max("row").alias("last"), F.min("row").alias("first"))
    pick = lambda c: F.coalesce(F.col("last")[c], F.col("first")[c]) if fill else F.col("last")[c]
    return both.select(*[c if c in keys else pick(c).alias(c) for c in stored.columns])


def kept_window(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows no more than so many days older than the newest."""
    (newest,) = fresh_name(rows, "newest")
    end = rows.agg(F.max(ts).alias(newest))
    return rows.crossJoin(F.broadcast(end)).filter(F.col(ts) >= F.col(newest) - F.expr(f"interval {days} days")).drop(newest)


def row_text(columns: list[str | Column]) -> Column:
    """A row as text; nulls told apart from empty text."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit("\\N")) for c in columns])


def content_hash(text: Column) -> Column:
    """An aggregate: 16 hex digits that tell a table's rows, repeats included, whatever their order."""
    part = lambda at: F.pmod(F.sum(F.conv(F.substring(F.md5(text.cast("binary")), at, 8), 16, 10).cast("decimal(38,0)")), F.lit(4_294_967_296).cast("decimal(38,0)"))
    digits = lambda at: F.lpad(F.lower(F.hex(F.coalesce(part(at), F.lit(0)).cast("long"))), 8, "0")
    return F.concat(digits(1), digits(9))


def manifest(rows: DataFrame, name: str, ts: str, columns: list[str | Column]) -> DataFrame:
    """name, rows, start, stop, content for each series."""
    return rows.groupBy(name).agg(F.count("*").alias("rows"), F.min(ts).alias("start"), F.max(ts).alias("stop"), content_hash(row_text(columns)).alias("content"))


def snapshot_id(entries: DataFrame, name: str) -> DataFrame:
    """One row: the data version that a fitted model records. entries: a manifest, a row a series."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "content"))), lambda e: F.concat_ws(":", e[name], e["content"])), "|")
    return entries.agg(F.substring(F.sha2(line, 256), 1, 16).alias("snapshot"))


def missing_windows(coverage: DataFrame, start: Column, stop: Column) -> DataFrame:
    """name's columns and gap_start, gap_stop: what of the window from start to stop (hours) coverage (start, stop) lacks at its ends."""
    hour = F.expr("interval 1 hour")
    before = F.when(start < F.col("start"), F.struct(start.alias("gap_start"), (F.col("start") - hour).alias("gap_stop")))
    behind = F.when(stop > F.col("stop"), F.struct((F.col("stop") + hour).alias("gap_start"), stop.alias("gap_stop")))
    return coverage.withColumn("gap", F.explode(F.filter(F.array(before, behind), lambda g: g.isNotNull()))).select(*[c for c in coverage.columns if c not in ("start", "stop")], "gap.*")


def problems(entries: DataFrame, name: str, now: Column, stale_days: int = 3, most_null: float = 0.02) -> DataFrame:
    """name and problem: missing, stale or full of nulls. entries: name, rows, stop, null_share."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("stop")) / 86_400)
    found = F.array(
        F.when(F.coalesce("rows", F.lit(0)) == 0, F.lit("missing")),
        F.when(days > stale_days, F.concat(F.lit("stale "), days.cast("string"), F.lit("d"))),
        F.when(F.col("null_share") > most_null, F.lit("nulls")),
    )
    return entries.select(name, F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def fingerprint(coefficients: DataFrame, name: str, value: str) -> DataFrame:
    """One row: what a model is, by its coefficients to ten places. coefficients: a row a feature."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, F.format_string("%.10f", F.col(value)).alias("v")))), lambda e: F.concat_ws("=", e[name], e["v"])), ";")
    return coefficients.agg(F.substring(F.sha2(line, 256), 1, 16).alias("fingerprint"))


def valid_states(states: DataFrame, current: DataFrame) -> DataFrame:
    """States that were learned against the current fingerprint; all others start anew. current: one row."""
    return states.join(F.broadcast(current.select("fingerprint")), "fingerprint", "left_semi")


def save(df: DataFrame, path: str) -> int:
    """df as the next version under a path; readers see the version before until the write is whole. Returns its number.

    A number that a write took and left unfinished isn't taken again.
    """
    version = max([0, *_folders(df.sparkSession, path)]) + 1
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def _folders(spark: SparkSession, path: str) -> dict[int, bool]:
    """The numbers of all versions under a path, and whether each is whole."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = [s.getPath() for s in files.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    return {int(p.getName().partition("=")[2]): files.exists(jvm.Path(p, "_SUCCESS")) for p in found}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions under a path, in order."""
    return sorted(n for n, whole in _folders(spark, path).items() if whole)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest whole version, or a certain one; None where there is none."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/version={version or known[-1]}") if known else None


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines."""
    df.write.mode("append").json(path)


def upsert(fresh: DataFrame, path: str, keys: list[str], ts: str = "ts", days: int | None = None) -> int:
    """The stored rows of a path with fresh ones in, as a new version; older than ``days`` before the newest go. Returns its number."""
    stored = load(fresh.sparkSession, path)
    rows = merged(fresh.limit(0) if stored is None else stored, fresh, keys)
    return save(kept_window(rows, ts, days) if days else rows, path)


def latest_by_lead(told: DataFrame, keys: list[str], date: str, most_dates: int) -> DataFrame:
    """Rows of the newest ``most_dates`` dates of each key."""
    (place,) = fresh_name(told, "place")
    return told.withColumn(place, F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(date)))).filter(F.col(place) <= most_dates).drop(place)
