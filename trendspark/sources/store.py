"""Run history as Parquet: items, clusters and, last, the row of the run, which makes the others visible.

Each write of a run has a name of its own, its attempt, in its row and in its items and clusters; readers take those of the
attempt in the row, of the last one finished where a run was written more than once. So a run that fails before its row is
written leaves files that no reader looks at, and a repeated write of a run takes the place of what was there.
Items and clusters are partitioned by the day of the run, so that readers of a run open one day.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = "run_id string, started_at double, finished_at double, ingested long, filtered long, cluster_count long, llm_mode string, exec_seconds double"
STORED = f"{RUN}, attempt string"
PREVIOUS_RUNS, HEADLINES = 5, 8


def _day(started_at: Column) -> Column:
    return F.date_format(F.timestamp_seconds(started_at), "yyyy-MM-dd")


def save_run(path: str, run: DataFrame, items: DataFrame, clusters: DataFrame) -> None:
    """Writes a run (one row of RUN) with its items (kept or not) and clusters, both with run_id; its row comes last."""
    attempt = F.lit(uuid.uuid4().hex)
    when = F.broadcast(run.select("run_id", _day(F.col("started_at")).alias("run_date")))  # one row
    for name, df in (("items", items), ("clusters", clusters)):
        df.join(when, "run_id").withColumn("attempt", attempt).write.mode("append").partitionBy("run_date").parquet(f"{path}/{name}")
    run.withColumn("attempt", attempt).write.mode("append").parquet(f"{path}/runs")


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """The row of each run: of its attempts the last one finished."""
    last = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc_nulls_last("finished_at"), "attempt"))
    return spark.read.schema(STORED).parquet(f"{path}/runs").withColumn("nth", last).where("nth = 1").drop("nth")


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    return stored_runs(spark, path).where("finished_at IS NOT NULL")


def of_runs(spark: SparkSession, path: str, name: str, runs: DataFrame) -> DataFrame:
    """Items or clusters of the given runs (as stored); the days of the runs prune the partitions at run time."""
    when = runs.select("run_id", "attempt", _day(F.col("started_at")).cast("date").alias("run_date"))
    return spark.read.parquet(f"{path}/{name}").join(F.broadcast(when), ["run_id", "attempt", "run_date"]).drop("run_date", "attempt")


def load_local(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished run and up to five before it, newest first, with the headlines of their best eight clusters."""
    newest = finished_runs(spark, path).orderBy(F.desc("started_at"), F.desc("run_id")).limit(PREVIOUS_RUNS + 1)
    return newest.join(headlines(of_runs(spark, path, "clusters", newest)), "run_id", "left").withColumn("nth", F.row_number().over(W.orderBy(F.desc("started_at"), F.desc("run_id"))))  # six rows


def headlines(clusters: DataFrame, top: int = HEADLINES) -> DataFrame:
    """(run_id, headlines): those of the best clusters of each run, in their order."""
    nth = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("combined_score"), "cluster_id"))
    best = clusters.withColumn("nth", nth).where(F.col("nth") <= top)
    return best.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "headline"))), lambda s: s["headline"]).alias("headlines"))


def readable_clusters(rows: DataFrame) -> DataFrame:
    """Clusters of rows whose entities, source_urls and sources are JSON text; rows that can't be read go.

    A null momentum is STEADY, a null basis cold_start.
    """
    out = rows
    for c in ("entities", "source_urls", "sources"):
        out = out.withColumn(c, F.from_json(F.coalesce(c, F.lit("[]")), "array<string>"))
    out = out.where("entities IS NOT NULL AND source_urls IS NOT NULL AND sources IS NOT NULL AND headline <> ''")
    return out.withColumn("momentum", F.coalesce("momentum", F.lit("STEADY"))).withColumn("velocity_basis", F.coalesce("velocity_basis", F.lit("cold_start")))


def kept_titles(items: DataFrame) -> DataFrame:
    """(run_id, text_key, weight) of kept items: a title counts as often as it was met."""
    return items.where("kept").select("run_id", "text_key", F.greatest(F.lit(1), F.coalesce("duplicate_count", F.lit(1))).alias("weight"))


def age_hours(started_at: Column, now: Column) -> Column:
    """Hours from a start to now, both in epoch seconds, 0 at least."""
    return F.greatest(F.lit(0.0), (now - started_at) / 3600)


def purge(spark: SparkSession, path: str, to: str, before: float) -> None:
    """Writes the history of runs that started at `before` or later to another place, items and clusters with their runs."""
    kept = stored_runs(spark, path).where(F.col("started_at") >= before)
    for name in ("items", "clusters"):
        left = spark.read.parquet(f"{path}/{name}").join(kept.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")
        left.write.partitionBy("run_date").parquet(f"{to}/{name}")
    kept.write.parquet(f"{to}/runs")


def cloud_report(spark: SparkSession, runs: DataFrame, cache: str, schema: str, folder: str = "{run}", files: str = "report-*.json") -> DataFrame:
    """One row (cloud_run, report, note): the last report, by its path, of the newest successful run, or why there is none.

    runs are rows (cloud_run, created_at, status); the reports of a run lie below its folder in the cache, one JSON object of
    the given schema a file. Only the folder of that run is read. A report without a run_id is not valid.
    """
    newest = runs.where("status = 'success'").orderBy(F.desc("created_at"), F.desc("cloud_run")).select("cloud_run").first()
    none = spark.range(1).select(F.lit(None).cast("string").alias("text"))
    if newest is None:
        return none.select(F.lit(None).cast("string").alias("cloud_run"), F.from_json("text", schema).alias("report"), F.lit("no successful run").alias("note"))
    run = str(newest[0])
    try:
        read = spark.read.text(f"{cache}/{folder.format(run=run)}", wholetext=True, recursiveFileLookup=True, pathGlobFilter=files)
        found = read.agg(F.max_by("value", "_metadata.file_path").alias("text"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = none
    report = found.select("text", F.from_json("text", schema).alias("report"))
    valid = F.col("report.run_id").isNotNull()
    note = F.when(F.col("text").isNull(), f"run {run} has no report").when(~valid, f"the report of run {run} can't be read")
    return report.select(F.lit(run).alias("cloud_run"), F.when(valid, F.col("report")).alias("report"), note.alias("note"))


def write_report(clusters: DataFrame, path: str) -> None:
    """Clusters as JSON lines, one file a task."""
    clusters.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
