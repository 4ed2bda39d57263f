"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import hadoop, shared_dir

class Scratch:
    """Tables of one operator call.  They cut lineage, survive lost executors and go when the session ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/nearfold-{label}-{uuid.uuid4().hex}"
        path, fs = hadoop(spark, self.path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        target = f"{self.path}/{name}"
        writer = df.write.option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def settle(self) -> None:
        """Between phases: Spark removes the shuffle files of plans that nothing holds any more.

        What Python lets go reaches the JVM with the next call, so the second collection is the one that finds it.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        path, fs = hadoop(self.spark, f"{self.path}/{name}")
        fs.delete(path, True)
