"""Tables written half-way through a job, in a folder shared by the whole cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


class Staging:
    """Written tables under ``root``, or under the session's ``spark.checkpoint.dir``; without either, an error.

    Tables stay until ``clear`` is called, or for good, as Spark's own checkpoints do.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        root = root or spark.conf.get(CHECKPOINT_SETTING, None)
        if not root:
            raise ValueError(f"give a staging folder that all executors share, or set {CHECKPOINT_SETTING}")
        self.spark = spark
        self.path = f"{root.rstrip('/')}/lares-{uuid.uuid4().hex}"

    def folder(self, purpose: str) -> str:
        """A fresh folder name."""
        return f"{self.path}/{purpose}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, purpose: str) -> DataFrame:
        """Writes ``df`` and returns the written table, which has no lineage beyond its files."""
        path = self.folder(purpose)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the tables written through this object."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
