"""Tables of an operator's own in the folder that all nodes share.

A written table cuts lineage and survives lost executors. The folder is spark.checkpoint.dir; only a
session on one machine may lack it, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-own-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_kept: dict[str, OwnTable] = {}


@atexit.register
def _drop_rest() -> None:
    """What callers did not drop goes with the session, as long as that still runs."""
    for table in list(_kept.values()):
        if table.spark.sparkContext._jsc and not table.spark.sparkContext._jsc.sc().isStopped():
            table.drop()


class OwnTable:
    """A DataFrame written once under a fresh name; `df` reads it, `drop` deletes it."""

    def __init__(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(self.path)
        self.schema = df.schema
        _kept[self.path] = self

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _kept.pop(self.path, None)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
