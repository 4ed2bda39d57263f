"""Incremental analysis of a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..schemas import FILES


def file_stream(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """Tables of files (Parquet) as they arrive in a folder."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", most).parquet(folder)


def run_incremental(engine: Engine, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch is ingested and clustered.  A batch that comes again finds its files up to date, and chunks
    that are stored but not clustered, if it failed between the two, are clustered then."""

    def step(batch: DataFrame, _: int) -> None:
        engine.cluster(engine.ingest(batch))

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch(engine: Engine, paths: list[str], checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """Follows folders: every so often a micro-batch brings the state up to what they hold.

    What was seen is told by the state and not by the stream, so a batch that failed or comes again does what is left to do,
    and each edit, new file or deletion reaches the engine once.
    """
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, __: engine.sync(paths)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()
