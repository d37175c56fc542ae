"""Structured Streaming over the event log and over arriving papers. Windowed counts are an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs

EVENTS = "run_id string, seq long, time timestamp, event string, chunk long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(path)


def status_stream(events: DataFrame) -> DataFrame:
    """Run states, kept up to date in state by run; use output mode ``complete`` or ``update``."""
    return runs.run_states(events)


def start_status(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every new state table to ``sink``; a batch number repeated after a failure replaces the earlier one."""
    return status_stream(events).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and window, with a watermark. time may be a timestamp without zone (read as UTC)."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def arriving_papers(spark: SparkSession, folder: str) -> DataFrame:
    """``paper_id, main_file, text`` of single-file papers as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.tex").load(folder)
    return raw.select(F.col("path").alias("paper_id"), F.element_at(F.split("path", "/"), -1).alias("main_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
