"""Run history: baselines by nearest run, velocity, snapshots, retention; the ledger; vectors, pages and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import text as X
from trendspark.functions.lexicon import STAGE_OF_REASON, WINDOWS
from trendspark.session import table


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs, one for each hour: start in epoch seconds, number of items kept; the newest isn't finished."""
    hour = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3600).cast("long")
    kept = table(spark, sf_dir, "events").groupBy(hour.alias("run_id")).agg(F.count_if(F.col("event_type") != "click").alias("kept"))
    newest = F.broadcast(kept.agg(F.max("run_id").alias("newest")))  # one row
    return kept.join(newest).select("run_id", F.col("run_id").cast("double").alias("started_at"), "kept", (F.col("run_id") < F.col("newest")).alias("finished"))


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "hours double, weight double")


def nearest_runs(r: DataFrame, w: DataFrame) -> DataFrame:
    """For each run and window of w hours the finished run nearest to w hours earlier, within half of w; none if that one kept nothing.

    Runs meet by hour buckets as wide as the longest reach in an equi-join, not all with all.
    """
    sec = F.col("hours") * 3600
    wanted = r.select(F.col("run_id").alias("now_id"), F.col("started_at").alias("now")).join(F.broadcast(w)).withColumn("lo", F.col("now") - 1.5 * sec).withColumn("hi", F.col("now") - 0.5 * sec)
    width = 6 * 3600
    wanted = wanted.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    past = r.where("finished").withColumn("bucket", F.floor(F.col("started_at") / width))
    met = wanted.join(past, "bucket").where(F.col("started_at").between(F.col("lo"), F.col("hi")) & (F.col("run_id") != F.col("now_id")))
    near = F.min_by(F.struct("run_id", "kept"), F.struct(F.abs(F.col("started_at") - (F.col("now") - sec)), "started_at"))
    return met.groupBy("now_id", "hours", "weight").agg(near.alias("near")).where("near.kept > 0").select("now_id", "hours", "weight", F.col("near.run_id").alias("ref_id"), F.col("near.kept").alias("ref_kept"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each entity in each run."""
    hour = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3600).cast("long")
    return table(spark, sf_dir, "events").groupBy(hour.alias("run_id"), F.col("event_type").alias("entity")).agg(F.count("*").alias("freq"))


def velocity(counts: DataFrame, near: DataFrame) -> DataFrame:
    """Velocity and momentum of each entity in each run that has a baseline: 50 + 50 x the weighted mean of tanh(growth / 2)."""
    totals = counts.groupBy("run_id").agg(F.sum("freq").alias("total"))
    rated = counts.join(totals, "run_id").select("run_id", "entity", "freq", "total", (100.0 * F.col("freq") / F.greatest(F.lit(1), F.col("total"))).alias("rate"))
    base = rated.select(F.col("run_id").alias("ref_id"), "entity", F.col("rate").alias("base"))
    now = rated.join(near, F.col("run_id") == F.col("now_id"))
    ref = totals.select(F.col("run_id").alias("ref_id"), F.col("total").alias("ref_total"))
    met = now.join(ref, "ref_id").join(base, ["ref_id", "entity"], "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    growth = (F.col("rate") - F.col("base")) / F.greatest(F.col("base"), 100.0 / F.col("ref_total"))
    out = met.groupBy("run_id", "entity", "freq").agg((50 + 50 * F.sum(F.col("weight") * F.tanh(growth / 2)) / F.sum("weight")).alias("v"), F.max("base").alias("most"))
    v = F.round("v", 3)
    return out.select("run_id", "entity", "freq", v.alias("velocity"), X.momentum(v, (F.col("most") == 0) & (F.col("freq") > 0), F.lit(False)).alias("momentum"))


def snapshots(counts: DataFrame) -> DataFrame:
    """The snapshot of an entity over the runs of a day: greatest frequency and greatest rate, each on its own."""
    totals = counts.groupBy("run_id").agg(F.sum("freq").alias("total"))
    rated = counts.join(totals, "run_id").withColumn("rate", F.round(100.0 * F.col("freq") / F.col("total"), 4))
    return rated.groupBy(F.floor(F.col("run_id") / 86_400).alias("day"), "entity").agg(F.max("freq").alias("freq"), F.max("rate").alias("rate"))


def latest_runs(r: DataFrame, k: int = 6) -> DataFrame:
    return r.where("finished").orderBy(F.desc("started_at")).limit(k).withColumn("nth", F.row_number().over(W.orderBy(F.desc("started_at"))))  # k rows


def retained(r: DataFrame, days: float = 7) -> DataFrame:
    """Runs that started within so many days of the newest."""
    newest = F.broadcast(r.agg(F.max("started_at").alias("newest")))  # one row
    return r.join(newest).where(F.col("started_at") >= F.col("newest") - days * 86_400).select("run_id", "started_at", "kept", "finished")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items by stage and reason, one row for each reason that occurs."""
    stage = F.create_map(*[F.lit(x) for kv in STAGE_OF_REASON.items() for x in kv])
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("raw_items")).withColumn("stage", stage[F.col("reason")])


def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order took in, discarded and kept, and whether it balances."""
    taken = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("ingested"), F.count_if(F.col("l_returnflag") == "R").alias("discarded"), F.count_if(F.col("l_returnflag").isin("A", "N")).alias("clustered"))
    return taken.select(F.col("l_orderkey").alias("run_id"), "ingested", "discarded", "clustered", (F.col("ingested") - F.col("discarded") - F.col("clustered")).alias("unaccounted"))


def cosine_gate(spark: SparkSession, sf_dir: str, least: float = 0.0) -> DataFrame:
    """Members of each label by their cosine to the label's centroid, the most central first; those below `least` go."""
    v = table(spark, sf_dir, "embeddings")
    parts = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroid = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    norm = lambda a: F.sqrt(X.dot(a, a))
    sim = X.dot(F.col("embedding"), F.col("c")) / (norm(F.col("embedding")) * norm(F.col("c")))
    return v.join(F.broadcast(centroid), "label").select("vec_id", "label", F.round(sim, 6).alias("similarity")).where(F.col("similarity") >= least)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", F.trim(title).alias("title"))


def history_tail(spark: SparkSession, sf_dir: str, turns: int = 2) -> DataFrame:
    """The last 2 x turns + 1 user and assistant messages of each conversation, cut to 4000 characters."""
    said = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return said.withColumn("back", back).where(F.col("back") <= 2 * turns + 1).select("conv_id", "turn", "role", F.substring("text", 1, 4000).alias("text"), "back")
