"""A table of many files replayed as a stream."""

from pyspark.sql import functions as F

from trendspark.streaming.loop import closed_hours


def test_files_of_overlapping_times_all_count(spark, tmp_path):
    # 250 files, each over all 20 hours: a stream by 100 files drops late rows from its third batch on.
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 72_000)
    rows = spark.range(5000).select(ts.alias("ts"), F.concat(F.lit("e"), F.col("id") % 3).alias("event_type"))
    rows.repartition(250).write.parquet(f"{tmp_path}/events.parquet")
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert len(events.inputFiles()) > 200
    last = events.agg(F.unix_timestamp(F.max("ts"))).first()[0]
    hours = events.groupBy((F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("run_id"), F.col("event_type").alias("entity")).agg(F.count("*").alias("freq"))
    want = sorted(tuple(r) for r in hours.where(F.col("run_id") + 3600 <= last).collect())
    assert want and sorted(tuple(r) for r in closed_hours(spark, str(tmp_path)).collect()) == want
