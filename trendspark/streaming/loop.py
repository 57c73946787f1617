"""Runs as a stream: new items are counted by hour, and each batch is appended to a table of run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import scratch_path


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int | None = 100) -> DataFrame:
    """The events table as a stream of its files; None: all there are in one batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, since the table may be a folder or one file, and a stream takes a plain path for a folder.
    reader = spark.readStream.schema(schema)
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{sf_dir}/events.parque[t]")


def hourly_counts(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Mentions of each entity in each closed hour; rows older than the watermark count no more. State holds open hours only."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    per = timed.groupBy(F.window("ts", "1 hour").alias("hour"), F.col("event_type").alias("entity")).agg(F.count("*").alias("freq"))
    return per.select(F.unix_timestamp("hour.start").alias("run_id"), "entity", "freq")


def append_history(counts: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts the query that appends closed hours to the table at path: on a clock, or once over all there is.

    The file sink commits a batch as a whole, so that readers never see half a run; a restart goes on from the checkpoint.
    """
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream over all events leaves in the history: the hours that ended by its last event.

    A table's files are in no order of time, so they are one batch: of several, later ones would count as late.
    """
    path = scratch_path(spark, "history")
    counts = hourly_counts(event_stream(spark, sf_dir, None))
    append_history(counts, path, scratch_path(spark, "history-checkpoint")).awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)
