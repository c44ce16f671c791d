"""A table of hourly series with an ordered log of commits: merges rewrite only the months that they touch, and writers don't block each other.

Under the table's folder, ``_log`` holds a file a version, which names the table's parts: the folder of each month. A writer writes new parts
under a name of its own, then puts the next version's file, which fails where another writer has put it first; it then looks at what the other
one changed, and merges anew only if they touched the same months. Readers follow the newest file, so a write that dies leaves nothing that
anyone sees; what it wrote is cleaned up later.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.names import fresh_name
from gridloom.sources.store import merged

NO_TIME = "none"


class Conflict(Exception):
    """Another writer was first, more often than a merge was tried."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: dict[str, str]
    schema: dict | None


class CommittedTable:
    """keys name a row; ts is the time whose month is a row's part. Rows without a ts are a part of their own."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], ts: str = "ts"):
        self.spark, self.path, self.keys, self.ts = spark, path.rstrip("/"), keys, ts
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.root = self._path("")
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_log") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest; 0 is the empty table."""
        number = (self.versions() or [0])[-1] if number is None else number
        if number == 0:
            return Version(0, {}, None)
        stream = self.files.open(self._path(f"_log/{number:010d}.json"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, told["parts"], told["schema"])

    def put(self, version: Version) -> bool:
        """The version's file, if there is none of its number: written under a name of its own, then renamed, which fails where the name is taken."""
        text = json.dumps({"parts": version.parts, "schema": version.schema})
        draft, goal = self._path(f"_log/.{uuid.uuid4().hex}"), self._path(f"_log/{version.number:010d}.json")
        out = self.files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.fs.FileContext.getFileContext(self.root.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, goal, never)
        except Exception as error:  # py4j wraps what the file system says
            self.files.delete(draft, False)
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _read(self, version: Version, months: list[str] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/{p}" for m, p in sorted(version.parts.items()) if months is None or m in months]
        return self.spark.read.schema(StructType.fromJson(version.schema)).parquet(*paths) if paths else None

    def load(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the newest; None before the first commit."""
        version = self.version(number)
        if version.schema is None:
            return None
        found = self._read(version)
        return self.spark.createDataFrame([], StructType.fromJson(version.schema)) if found is None else found

    def _month(self) -> Column:
        return F.coalesce(F.date_format(self.ts, "yyyy-MM"), F.lit(NO_TIME))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """New parts of rows by month, in one job; a month's rows are dealt over several files by key, so that no task writes a whole month."""
        (month,) = fresh_name(rows, "month")
        name = f"data/{uuid.uuid4().hex}"
        marked = rows.withColumn(month, self._month())
        marked.repartition(month, F.pmod(F.xxhash64(*self.keys), F.lit(16))).write.partitionBy(month).parquet(f"{self.path}/{name}")
        return {p.partition("=")[2]: f"{name}/{p}" for p in self._names(name) if p.startswith(f"{month}=")}

    def merge(self, fresh: DataFrame, fill: bool = False, tries: int = 5) -> int:
        """fresh rows in place of stored ones of the same keys (see ``store.merged``), as a new version; returns its number.

        Only months that fresh has rows of are read and written. A key must not move between months. An empty fresh table makes a version
        only where there is none yet.
        """
        touched = [r["m"] for r in fresh.select(self._month().alias("m")).distinct().collect()]  # as many as the calendar has months
        base, parts = self.version(), None
        for _ in range(tries):
            if parts is None:
                stored = self._read(base, touched)
                rows = merged(fresh.limit(0) if stored is None else stored, fresh, self.keys, fill)
                parts = self._write(rows) if touched else {}
            if not touched and base.schema is not None:
                return base.number
            if self.put(Version(base.number + 1, {**base.parts, **parts}, base.schema or fresh.schema.jsonValue())):
                return base.number + 1
            newest = self.version()
            if any(newest.parts.get(m) != base.parts.get(m) for m in touched):
                parts = None  # another writer changed these months: merge into what it left
            base = newest
        raise Conflict(f"{tries} commits to {self.path} were overtaken")

    def drop_before(self, first: str, tries: int = 5) -> int:
        """A version without the months before ``first`` (yyyy-MM); rows without a time stay. Nothing is rewritten."""
        for _ in range(tries):
            base = self.version()
            kept = {m: p for m, p in base.parts.items() if m == NO_TIME or m >= first}
            if kept == base.parts:
                return base.number
            if self.put(Version(base.number + 1, kept, base.schema)):
                return base.number + 1
        raise Conflict(f"{tries} commits to {self.path} were overtaken")

    def clean(self, keep: int = 2, idle_seconds: int = 86_400) -> list[str]:
        """Deletes log files but the newest ``keep``, and parts that none of these names and that nobody has written to for so long (a writer may
        still be about to name them). Returns the parts deleted."""
        numbers = self.versions()
        for old in numbers[: -keep or None]:
            self.files.delete(self._path(f"_log/{old:010d}.json"), False)
        named = {p for n in numbers[-keep:] for p in self.version(n).parts.values()}
        now, gone = self.spark._jvm.java.lang.System.currentTimeMillis(), []
        for name in self._names("data"):
            folder = f"data/{name}"
            parts = [f"{folder}/{p}" for p in self._names(folder) if "=" in p]
            if now - self.files.getFileStatus(self._path(folder)).getModificationTime() < idle_seconds * 1000:
                continue
            dead = [p for p in parts if p not in named]
            for p in dead if len(dead) < len(parts) else [folder]:
                self.files.delete(self._path(p), True)
            gone += dead
        return gone
