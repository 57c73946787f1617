"""All sources of a run from stored payloads: items in the order of the registry, and a row of statistics for each source.

A payload is a row (run_id, source, place, part, form, status, error, payload, run_ts): place is its turn in its source,
part what was asked for (a feed, day, page, year or number of a query), form tells a listing's JSON from its Atom form, error
is what kept the payload from being fetched. A run has one run_ts, which no other run has. Fetching is the caller's; no payload
stops a run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.sources import feeds
from trendspark.session import materialize

CAP, ERROR_CHARS = 40, 300
COLUMNS = ("run_id", "source", "place", "part", "form", "status", "error", "payload", "run_ts")


@dataclass(frozen=True)
class Source:
    """How a source is read. kind: json, xml or text (which is never corrupt). rule: `any` payload that can be read counts,
    the `first` one alone does, or `all` must be. needs_items: a source without an item has failed."""

    decode: Callable[[DataFrame], DataFrame]
    kind: str = "text"
    rule: str = "all"
    part: str | None = None
    needs_items: bool = True


def _reddit(df: DataFrame) -> DataFrame:
    listings = df.where("coalesce(form, 'json') = 'json'").select("feed", "place", "status", "payload", "run_ts")
    return feeds.reddit_feeds(listings, df.where("form = 'rss'").select("feed", "payload", "run_ts"), keep_run=True)


#: In the order in which their items come.
REGISTRY: dict[str, Source] = {
    "x_trends24": Source(feeds.x_trends),
    "reddit": Source(_reddit, rule="any", part="feed string"),
    "tiktok": Source(feeds.tiktok_hashtags, part="page string"),
    "google_trends": Source(feeds.google_trends, "xml", "first", needs_items=False),
    "google_news": Source(feeds.google_news, "xml", needs_items=False),
    "wikipedia": Source(feeds.wikipedia_top, "json", "first", "day date", False),
    "arxiv": Source(feeds.arxiv, "xml", needs_items=False),
    "ai_papers": Source(feeds.papers_of_the_year, rule="any", part="year int"),
    "hackernews": Source(feeds.hacker_news, "json", "any", "query_no int"),
    "github": Source(feeds.github_trending),
    "producthunt": Source(feeds.product_hunt, "xml"),
}


def fault(kind: str) -> Column:
    """Why a payload can't be read, null if it can: what its fetch met, a status other than 200, a text that is none of its kind."""
    status = F.when(F.coalesce("status", F.lit(200)) != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    text = F.coalesce("payload", F.lit(""))
    if kind == "json":
        broken = F.when(F.try_parse_json(text).isNull(), "invalid JSON")
    elif kind == "xml":
        # The first thing after the prolog must be an element that is closed by the same name at the end.
        name = F.regexp_extract(text, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<([A-Za-z_][\w:.-]*)", 1)
        read = F.from_xml("payload", "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"]
        ends = F.regexp_extract(F.rtrim(text), r"</([A-Za-z_][\w:.-]*)\s*>$", 1)
        broken = F.when((name == "") | (name != ends) | read.isNotNull(), "invalid XML")
    else:
        broken = F.when(F.col("payload").isNull(), "no payload")
    return F.coalesce("error", status, broken)


def ingest(payloads: DataFrame, names: list[str] | None = None, cap: int | None = CAP) -> tuple[DataFrame, DataFrame]:
    """(items, stats) of the sources named, all of the registry without names; an unknown name is an error.

    items: run_id, source_no (the source's place in the registry), nth, and the columns of feeds.ITEM; `cap` of a source at
    most, all without a cap. stats: run_id, source, ok, item_count and error (of at most ERROR_CHARS characters), a row for each source and
    run of which there is a payload. A source that failed has no items. Payloads of other sources are left alone.
    """
    if unknown := sorted(set(names or ()) - REGISTRY.keys()):
        raise ValueError(f"no such source: {', '.join(unknown)}")
    every = materialize(payloads.select(*COLUMNS), "payloads")
    runs = every.select("run_id", F.col("run_ts").alias("_run")).distinct()
    items, stats = None, None
    for no, (name, source) in enumerate(REGISTRY.items()):
        if names is not None and name not in names:
            continue
        own = every.where(F.col("source") == name).withColumn("fault", fault("text" if name == "reddit" else source.kind))
        if name == "reddit":  # a listing that can't be read gives way to the Atom form, so it is no fault by itself
            own = own.withColumn("fault", F.when(F.col("error").isNotNull(), F.col("error")))
        own = materialize(own, f"{name}-payloads")
        told = own.groupBy("run_id").agg(
            F.count_if(F.col("fault").isNull()).alias("good"), F.count_if(F.col("fault").isNotNull()).alias("bad"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("place"))).alias("first_fault"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fault").isNotNull(), F.struct("place", F.concat_ws(": ", "part", "fault").alias("said"))))), lambda s: s["said"]), "; ").alias("said"),
        )
        read = own.where("fault IS NULL").withColumn("_run", F.struct("run_id", "place"))
        if source.rule == "first":
            read = read.withColumn("_nth", F.row_number().over(W.partitionBy("run_id").orderBy("place"))).where("_nth = 1").drop("_nth")
        if source.part:
            column, kind = source.part.split()
            read = read.withColumn(column, F.col("part").try_cast(kind))
        got = source.decode(read)
        if name == "reddit":  # its posts have their order already
            got = got.select("_run", *feeds.ITEM, F.lit(0).alias("place"), "nth").join(runs, "_run")
        else:
            got = got.select("_run.run_id", *feeds.ITEM, "_run.place", F.col("rank").alias("nth"))
        nth = F.row_number().over(W.partitionBy("run_id").orderBy("place", "nth", "title", "url"))
        got = got.withColumn("nth", nth)
        got = materialize((got if cap is None else got.where(F.col("nth") <= cap)).select("run_id", F.lit(no).alias("source_no"), "nth", *feeds.ITEM), f"{name}-items")
        n = got.groupBy("run_id").agg(F.count("*").alias("n"))
        told = told.join(n, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        broken = (F.col("bad") > 0) if source.rule == "all" else (F.col("good") == 0) if source.rule == "first" else F.lit(False)
        empty = (F.col("n") == 0) & F.lit(source.needs_items)
        why = F.when(broken, F.col("first_fault") if source.rule == "all" else F.col("said")).when(empty, F.coalesce(F.nullif(F.col("said"), F.lit("")), F.lit("no items")))
        stat = told.select("run_id", F.lit(name).alias("source"), why.isNull().alias("ok"), F.when(why.isNull(), F.col("n")).otherwise(0).cast("long").alias("item_count"), F.substring(why, 1, ERROR_CHARS).alias("error"))
        stat = materialize(stat, f"{name}-stats")
        got = got.join(stat.where("ok").select("run_id"), "run_id", "left_semi")
        items, stats = (got, stat) if items is None else (items.unionByName(got), stats.unionByName(stat))
    return items, stats
