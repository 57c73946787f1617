"""Entity snapshots as Parquet with an upsert: generations by day, and a manifest of those that count.

A write adds one generation of each day it has rows of; a compaction writes one that takes the place of those it read.
Either counts from the moment its row is in the manifest, (day, generation, replaces), one file, so readers see a write or a
compaction whole or not at all. On reading, the rows of a run and entity are one: the greatest frequency, the greatest
rate and the greatest count of attempts each on its own, the label and time of the row that was written first.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "run_id string, entity_key string, entity_label string, frequency long, rate double, captured_at double"
STORED = f"{ROWS}, attempt long, snap_date date, generation string"
MANIFEST = "snap_date date, generation string, replaces array<string>"


def of_run(entities: DataFrame) -> DataFrame:
    """(run_id, entity_key, entity_label, frequency, rate): of the entities of a run's clusters (run_id, entity_key, ord, label,
    freq, rate) the most frequent one of each key, the one met first on ties; one that no title names has no row."""
    best = F.max_by(F.struct("label", "freq", "rate"), F.struct("freq", -F.col("ord"))).alias("b")
    found = entities.where("freq > 0 AND entity_key <> ''").groupBy("run_id", "entity_key").agg(best)
    return found.select("run_id", "entity_key", F.col("b.label").alias("entity_label"), F.col("b.freq").alias("frequency"), F.round("b.rate", 4).alias("rate"))


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return None


def _commit(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.select("snap_date", "generation", "replaces").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _write(rows: DataFrame, path: str) -> str:
    generation = uuid.uuid4().hex
    rows.write.partitionBy("snap_date").parquet(f"{path}/rows/generation={generation}")
    return generation


def save(path: str, rows: DataFrame, attempt: int = 0) -> None:
    """Adds rows (ROWS) of runs; of two writes the one with the smaller attempt was first, then the earlier captured_at."""
    spark = rows.sparkSession
    day = F.to_date(F.timestamp_seconds("captured_at")).alias("snap_date")
    generation = _write(rows.select(*(c.split()[0] for c in ROWS.split(", ")), F.lit(attempt).cast("long").alias("attempt"), day), path)
    days = spark.read.parquet(f"{path}/rows/generation={generation}").select(F.col("snap_date").cast("date").alias("snap_date")).distinct()
    _commit(spark, path, days.select("snap_date", F.lit(generation).alias("generation"), F.array().cast("array<string>").alias("replaces")))


def _live(manifest: DataFrame) -> DataFrame:
    """(snap_date, generation) of the generations of each day that no other has replaced."""
    gone = manifest.select("snap_date", F.explode("replaces").alias("generation"))
    return manifest.select("snap_date", "generation").distinct().join(gone, ["snap_date", "generation"], "left_anti")


def _merged(rows: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("entity_label", "captured_at"), F.struct("attempt", "captured_at", "entity_label"))
    out = rows.groupBy("run_id", "entity_key").agg(first.alias("first"), F.max("frequency").alias("frequency"), F.max("rate").alias("rate"), F.min("attempt").alias("attempt"), F.min("snap_date").alias("snap_date"))
    return out.select("run_id", "entity_key", "first.entity_label", "frequency", "rate", "first.captured_at", "attempt", "snap_date")


def _rows(spark: SparkSession, path: str, live: DataFrame) -> DataFrame:
    stored = spark.read.schema(STORED).parquet(f"{path}/rows")
    return stored.join(live, ["snap_date", "generation"], "left_semi")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row (ROWS) for each run and entity; none where nothing was saved. A row written late may lie in another day."""
    manifest = _manifest(spark, path)
    if manifest is None:
        return spark.createDataFrame([], ROWS)
    return _merged(_rows(spark, path, _live(manifest))).select(*(c.split()[0] for c in ROWS.split(", ")))


def compact(spark: SparkSession, path: str, day: str) -> int:
    """Rewrites a day as one generation, and tells how many it replaced; 0 where there was one at most."""
    manifest = _manifest(spark, path)
    live = [] if manifest is None else [r["generation"] for r in _live(manifest.where(F.col("snap_date") == day)).collect()]  # the writes of a day
    if len(live) < 2:
        return 0
    rows = spark.read.schema(STORED).parquet(f"{path}/rows").where((F.col("snap_date") == day) & F.col("generation").isin(live)).drop("generation")
    generation = _write(_merged(rows), path)
    _commit(spark, path, spark.createDataFrame([(day, generation, live)], "snap_date string, generation string, replaces array<string>").withColumn("snap_date", F.col("snap_date").cast("date")))
    return len(live)
