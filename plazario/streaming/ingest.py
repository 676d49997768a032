"""Continuous ingest: recorded records arrive as files, repeats are dropped, batches go to the raw layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def once(stream: DataFrame, key: str = "job_id", time: str = "fetched_at", late: str = "30 days") -> DataFrame:
    """The first arrival of each identifier within the watermark.

    Rows without time count as of the moment they are read, so all identifiers share one state, which the watermark bounds; their time stays null.
    """
    at = F.coalesce(F.col(time).cast("timestamp"), F.current_timestamp())
    return stream.withColumn("__arrived", at).withWatermark("__arrived", late).dropDuplicatesWithinWatermark([key]).drop("__arrived")


def per_window(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Arrivals by window and keys, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def run_batches(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start ``process`` on every micro-batch that is there, then stop; the checkpoint makes a restart resume."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(process).start()
