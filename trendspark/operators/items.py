"""Items from ingestion to selection: caps, filters, duplicates, scores and the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import text as X
from trendspark.functions.lexicon import DEFAULT_WEIGHT, SOCIAL, SOURCE_WEIGHTS, SOURCES
from trendspark.operators.links import shares
from trendspark.operators.overlaps import alike, numbered
from trendspark.session import drop, materialize, short_shuffles, table

SOURCE_CAP, BUDGET, FLOOR = 40, 150, 6


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items: title the first line, the source by number, the score the length."""
    d = table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 9).cast("int") % len(SOURCES)
    return d.select(
        (F.col("doc_id") + 1).alias("item_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 350).alias("title"),
        F.element_at(F.array(*map(F.lit, SOURCES)), number + 1).alias("source"),
        F.col("n_chars").cast("double").alias("raw_score"),
        (F.col("n_chars") % 97).alias("comment_count"),
    )


def source_cap(df: DataFrame, cap: int = SOURCE_CAP) -> DataFrame:
    """The first items of each source; WindowGroupLimit keeps no more than cap rows of a source from each task."""
    rank = F.row_number().over(W.partitionBy("source").orderBy("item_id"))
    return df.withColumn("position", rank).where(F.col("position") <= cap)


def discard_reason(df: DataFrame) -> DataFrame:
    """df with the reason of the first rule that fires, null for items that pass."""
    score, comments = F.coalesce("raw_score", F.lit(0.0)), F.coalesce("comment_count", F.lit(0))
    alnum = F.regexp_replace("title", "[^A-Za-z0-9]", "")
    source = F.col("source")
    reason = (
        F.when((source == "reddit") & ((score < 20) | (comments < 5)), "reddit_low_engagement")
        .when((source == "hackernews") & (score < 10), "hn_low_points")
        .when((source == "github") & (score < 20), "github_low_stars")
        .when((F.length(alnum) < 2) | alnum.rlike("^[0-9]+$"), "too_short_or_non_ascii")
        .when(source.isin(*SOCIAL) & (F.size(X.significant_tokens(F.col("title"))) == 0) & ~F.col("title").rlike("[A-Z]"), "no_signal_tokens")
    )
    return df.withColumn("discard_reason", reason)


def exact_groups(df: DataFrame) -> DataFrame:
    """One row for each title key: the best-scored item (the first on ties), the number of items and their sources."""
    best = F.max_by(F.struct("item_id", "title", "source", "raw_score", "comment_count"), F.struct(F.coalesce("raw_score", F.lit(0.0)), -F.col("item_id")))
    grouped = df.groupBy(X.dedupe_key(F.col("title")).alias("title_key")).agg(best.alias("b"), F.count("*").alias("duplicate_count"), F.min("item_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return grouped.select("title_key", "b.*", "duplicate_count", "first_id", "sources")


def percentile(df: DataFrame) -> DataFrame:
    """df with the mid-rank percentile of the score in its source, 0.75 for a source's only item.

    Ranks come from the distinct scores of a source, so a hot source is a window over its distinct scores, not its rows.
    """
    s = F.coalesce("raw_score", F.lit(0.0))
    equal = df.groupBy("source", s.alias("s")).agg(F.count("*").alias("equal"))
    to_here = F.sum("equal").over(W.partitionBy("source").orderBy("s"))
    ranked = equal.withColumn("upto", to_here).withColumn("n", F.sum("equal").over(W.partitionBy("source")))
    ranked = ranked.select("source", "s", F.when(F.col("n") <= 1, 0.75).otherwise((F.col("upto") - F.col("equal") + 0.5 * F.col("equal")) / F.col("n")).alias("pct"))
    return df.withColumn("s", s).join(ranked, ["source", "s"]).drop("s")


def scored(df: DataFrame) -> DataFrame:
    """Distinct items with their heuristic score: percentile, corroboration by other sources, duplicates, engagement.

    A source corroborates an item if it has another item with a token of it that at most the cap of items have.
    """
    # Used four times below: written out, so that the items are scanned and grouped once.
    pct = materialize(percentile(materialize(exact_groups(df), "groups")), "percentiles")
    words = pct.select("item_id", "source", F.explode(X.significant_tokens(F.col("title"))).alias("token"))
    n = F.broadcast(pct.agg(F.greatest(F.lit(3), F.floor(0.08 * F.count("*"))).alias("cap")))  # one row
    per = words.groupBy("token").agg(F.count("*").alias("df"), F.collect_set("source").alias("seen"))  # at most all sources
    rare = per.join(n, F.col("df") <= F.col("cap")).select("token", "seen")
    others = words.join(rare, "token").groupBy("item_id", "source").agg(F.array_distinct(F.flatten(F.collect_set("seen"))).alias("seen"))
    others = others.select("item_id", F.size(F.array_remove("seen", F.col("source"))).alias("others"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv]), F.col("source")), F.lit(DEFAULT_WEIGHT))
    talk = F.when(F.coalesce("comment_count", F.lit(0)) > 0, F.least(F.lit(0.10), F.log10(1 + F.col("comment_count")) / 30)).otherwise(0.0)
    score = 0.20 + 0.45 * F.col("pct") * weight + 0.10 * F.least(F.lit(3), F.coalesce("others", F.lit(0))) + F.least(F.lit(0.15), 0.05 * (F.col("duplicate_count") - 1)) + talk
    return pct.join(others, "item_id", "left").withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def select_budget(df: DataFrame, cap: int = BUDGET, floor: int = FLOOR) -> DataFrame:
    """The budget: the best `floor` of each source, then the best of all, `cap` at most; in order of score."""
    placed = df.withColumn("in_floor", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "item_id")) <= floor)
    picked = placed.orderBy(F.desc("in_floor"), F.desc("score"), "item_id").limit(cap)
    return picked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "item_id")))  # cap rows


def link_pairs(df: DataFrame) -> DataFrame:
    """Pairs of items that share at least two tokens which at most the cap of items have, with jaccard of 0.25 or more.

    The cap is a tenth of the items, 12 at least. Pairs are counted over tiles of items and judged there, so none is shuffled.
    """
    with short_shuffles(df.sparkSession):
        df = materialize(df.select(F.col("item_id").cast("long").alias("item_id"), "tokens"), "item-tokens")
        words = df.select("item_id", F.explode("tokens").alias("token"), F.size("tokens").cast("long").alias("size"))
        cap = df.agg(shares(F.count("*"))[2].alias("cap"))
        rare = numbered(words.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(cap)).where("df <= cap").select("token"), [])  # one row
        sets = words.join(rare, "token").groupBy("item_id").agg(F.first("size").alias("size"), F.collect_list("number").alias("tokens")).where(F.size("tokens") > 1)
        sets = materialize(sets.withColumn("node", F.col("item_id")), "token-sets")
        drop(df)
        drop(rare)
    pairs = alike(sets, lambda shared, _, left, right: (shared >= 2) & (shared / (left + right - shared) >= 0.25))
    return pairs.select("left_id", "right_id", "shared", F.round(F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared")), 6).alias("jaccard"))
