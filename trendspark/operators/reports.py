"""A report as text for a model that answers questions about it, and as JSON for an interface: one row for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions import normalize as N

LINKS = 4

# The words of a report.
HEAD = "REPORT: %s, started %s UTC (%.1f hours ago), engine %s, %d items ingested, %d trends."
TREND = "   relevance %d/10 | velocity %.0f %s%s | %d items from %s"
NO_TRENDS = "(none: this run produced no trends)"


def _in_order(value: Column, *order: str) -> Column:
    """The values of a group in the given order; of null values none."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("value")))))
    return F.transform(rows, lambda r: r["value"])


def _joined(values: Column, lead: str, by: str = ", ") -> Column:
    """Values behind a lead, null for none."""
    return F.when(F.size(values) > 0, F.concat(F.lit(lead), F.array_join(values, by)))


def _at(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def _trend() -> Column:
    """The lines of a trend."""
    windows = F.filter(F.coalesce("windows", F.array().cast("array<struct<hours:double,growth:double>>")), lambda w: w["growth"].isNotNull())
    growth = F.transform(windows, lambda w: F.format_string("%sh %+.0f%%", F.regexp_replace(w["hours"].cast("string"), r"\.0$", ""), w["growth"] * 100))
    growth = F.when(F.size(growth) > 0, F.concat(F.lit(" ("), F.array_join(growth, ", "), F.lit(")"))).otherwise("")
    sources = F.when(F.size("sources") > 0, N.display_sources(F.col("sources"))).otherwise("unknown sources")
    return F.concat_ws(
        "\n",
        F.format_string("#%d [%s] %s", "rank", "category", N.normalize_text(F.col("headline"))),
        F.format_string(TREND, "relevance", "velocity", "momentum", growth, "items", sources),
        F.concat(F.lit("   summary: "), N.normalize_text(F.col("summary"))),
        _joined(F.col("entities"), "   entities: "),
        _joined(F.transform(F.slice("source_urls", 1, LINKS), lambda u: F.concat(F.lit("   link: "), u)), "", "\n"),
    )


def grounding(runs: DataFrame, clusters: DataFrame, stats: DataFrame, earlier: DataFrame) -> DataFrame:
    """(run_id, text): what a model is told of each run.

    runs (run_id, origin_label, started_at, now, llm_mode, ingested), clusters (run_id, rank, category, headline, relevance,
    velocity, momentum, windows, items, sources, summary, entities, source_urls), stats (run_id, place, source, ok, item_count,
    error) and earlier runs (run_id, started_at, headlines) are rows of a report each, some tens for each run.
    """
    said = clusters.groupBy("run_id").agg(F.count("*").alias("trends"), _in_order(_trend(), "rank").alias("lines"))
    good = F.when(F.col("ok"), F.concat_ws(" ", "source", F.col("item_count").cast("string")))
    bad = F.when(~F.col("ok"), F.concat("source", F.lit(" ("), F.substring(F.coalesce("error", F.lit("failed")), 1, 60), F.lit(")")))
    health = stats.groupBy("run_id").agg(_in_order(good, "place").alias("good"), _in_order(bad, "place").alias("bad"))
    headlines = F.coalesce(F.nullif(F.array_join("headlines", "; "), F.lit("")), F.lit("no trends"))
    was = earlier.select("run_id", (-F.col("started_at")).alias("nth"), F.concat(F.lit("- "), _at(F.col("started_at")), F.lit(" UTC: "), headlines).alias("line"))
    was = was.groupBy("run_id").agg(_in_order(F.col("line"), "nth").alias("was"))
    all_of = runs.join(said, "run_id", "left").join(health, "run_id", "left").join(was, "run_id", "left")
    hours = F.greatest(F.lit(0.0), (F.col("now") - F.col("started_at")) / 3600)
    head = F.format_string(HEAD, "origin_label", _at(F.col("started_at")), hours, "llm_mode", "ingested", F.coalesce("trends", F.lit(0)))
    sources = F.when(F.col("good").isNotNull(), F.concat(F.lit("Sources OK: "), F.array_join("good", ", "), F.coalesce(_joined(F.col("bad"), ". Failed: ", "; "), F.lit(""))))
    text = F.concat_ws("\n", head, sources, F.lit(""), F.lit("TRENDS (ranked):"), F.coalesce(F.array_join("lines", "\n"), F.lit(NO_TRENDS)), _joined(F.col("was"), "\nEARLIER RUNS (local history, newest first):\n", "\n"))
    return all_of.select("run_id", text.alias("text"))


def api_projection(runs: DataFrame, clusters: DataFrame, stats: DataFrame) -> DataFrame:
    """(run_id, payload): each run of `grounding` as a JSON object, its trends in order of rank and its sources by place."""
    trend = F.struct(
        "rank", "headline", "category", F.col("relevance").alias("relevance"), F.round("velocity", 1).alias("velocity"), "momentum", "summary", "entities", F.col("source_urls").alias("urls"), "sources", "items"
    )
    trends = clusters.groupBy("run_id").agg(_in_order(trend, "rank").alias("trends"))
    health = stats.groupBy("run_id").agg(_in_order(F.struct("source", "ok", "item_count", "error"), "place").alias("source_stats"))
    hours = F.round(F.greatest(F.lit(0.0), (F.col("now") - F.col("started_at")) / 3600), 2)
    started = F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    all_of = runs.join(trends, "run_id", "left").join(health, "run_id", "left")
    none = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), all_of.schema[c].dataType.simpleString()))
    body = F.struct(F.lit(True).alias("available"), "origin_label", "run_id", started.alias("started_at"), hours.alias("age_hours"), "llm_mode", none("trends").alias("trends"), none("source_stats").alias("source_stats"))
    return all_of.select("run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
