"""Written tables that cut lineage, in the folder that all executors share.

The folder is ``spark.checkpoint.dir``. Only where that is unset, and only with a local master, as in tests, a folder of this process
is set as the checkpoint folder; on a cluster no machine's own folder will do, and an error says so.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from gridloom.names import fresh_name as fresh_name


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one is set only if it names none and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


class Scratch:
    """Parquet tables of one operator call, each under a name of its own."""

    #: The folders made since the innermost ``released`` began.
    made: list[Scratch] = []
    outer: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False):
        """lasting: the tables belong to what the operator returns, and go with the caller's."""
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        (Scratch.outer if lasting else Scratch.made).append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back; a lost executor then costs a read, not the lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that no returned plan reads; without a name, all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released() -> Iterator[None]:
    """Deletes at its end the tables of all operator calls within, other than lasting ones; what needs them must have been written by then."""
    before, above = Scratch.made, Scratch.outer
    Scratch.made, Scratch.outer = [], before
    try:
        yield
    finally:
        inside, Scratch.made, Scratch.outer = Scratch.made, before, above
        for scratch in inside:
            scratch.drop()
