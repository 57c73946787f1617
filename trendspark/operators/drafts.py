"""Drafts of clusters: roll-up, relevance, category, reasons to drop one, scores, merging, claims on items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions.lexicon import CATEGORIES, SOURCES
from trendspark.session import table

URLS, LEAST_RELEVANCE = 10, 4


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as members of drafts, one draft for each order."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    key = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("draft_id"),
        (key * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("item_id"),
        (F.col("l_discount") * 10).alias("score"),
        pick(SOURCES, F.col("l_suppkey") % len(SOURCES)).alias("source"),
        F.col("l_linenumber").cast("long").alias("duplicate_count"),
        F.concat(F.lit("https://example.org/"), key % 50).alias("url"),
        F.when(key % 7 != 0, pick(CATEGORIES, key % len(CATEGORIES))).alias("hint"),
        F.col("l_quantity").alias("quantity"),
    )


def rollup(m: DataFrame) -> DataFrame:
    """One row for each draft: members, raw items, sources, the means that scores need, the first URLs.

    URLs are ranked after they are made distinct, and ranks above URLS stay behind, so no array grows with a draft.
    """
    plain = m.groupBy("draft_id").agg(
        F.count("*").alias("members"), F.sum(F.greatest(F.lit(1), F.col("duplicate_count"))).alias("raw_items"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.bround((F.max("quantity") % 10) + 1, 0).cast("int").alias("llm_relevance"),
    )  # a set of sources holds at most all sources
    urls = m.where(F.col("url").isNotNull()).groupBy("draft_id", "url").agg(F.min("item_id").alias("first"))
    nth = F.row_number().over(W.partitionBy("draft_id").orderBy("first", "url"))
    urls = urls.withColumn("nth", nth).where(F.col("nth") <= URLS).groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "url"))), lambda s: s["url"]).alias("urls"))
    return plain.join(urls, "draft_id", "left")


def category_mode(m: DataFrame, default: str = "News") -> DataFrame:
    """The most frequent hint of a draft, the one seen first on ties; `default` stands for no hint."""
    each = m.groupBy("draft_id", F.coalesce("hint", F.lit(default)).alias("category")).agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    return each.groupBy("draft_id").agg(F.max_by("category", F.struct("n", -F.col("first"))).alias("category"))


def scored(drafts: DataFrame, llm_weight: float = 0.65, relevance_weight: float = 0.6) -> DataFrame:
    """Relevance by members, blended relevance, velocity without history, and the order of drafts."""
    spread = F.least(F.lit(1.0), F.size("sources") / 3)
    size = F.least(F.lit(1.0), F.log2(1.0 + F.col("raw_items")) / F.log2(F.lit(9.0)))
    heuristic = 1 + 9 * (0.40 * F.col("mean_score") + 0.35 * spread + 0.25 * size)
    blend = F.greatest(F.lit(1), F.least(F.lit(10), F.bround(F.round(llm_weight * F.col("llm_relevance") + (1 - llm_weight) * heuristic, 6), 0).cast("int")))
    cold = 50 + 30 * (2 * F.col("mean_score") - 1) + 10 * spread
    velocity = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(cold, 6))), 1)
    out = drafts.withColumn("heuristic_relevance", F.round(heuristic, 6)).withColumn("relevance", blend).withColumn("velocity", velocity)
    return out.withColumn("combined", F.round(relevance_weight * F.col("relevance") * 10 + (1 - relevance_weight) * F.col("velocity"), 2))


def drop_reason(drafts: DataFrame) -> DataFrame:
    """drafts with the first reason to drop one, null for those that stay."""
    lone = (F.col("members") < 2) & (F.size("sources") < 2) & (F.col("raw_items") < 2)
    weak = lone & (F.col("best_score") < 0.80) & (F.col("llm_relevance") < 7)
    return drafts.withColumn("drop_reason", F.when(F.col("llm_relevance") < LEAST_RELEVANCE, "low_relevance").when(weak, "weak_singleton"))


def report(drafts: DataFrame, top: int = 15) -> DataFrame:
    """The report: the best drafts by combined score, relevance and raw items, with their rank."""
    order = [F.desc("combined"), F.desc("relevance"), F.desc("raw_items"), F.asc("draft_id")]
    return drafts.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # top rows


def merge_clusters(drafts: DataFrame, key: str) -> DataFrame:
    """Drafts of one key as one: counts added, greatest relevance; what was said of it stays that of the first."""
    return drafts.groupBy(key).agg(F.min("draft_id").alias("draft_id"), F.sum("members").alias("members"), F.sum("raw_items").alias("raw_items"), F.max("relevance").alias("relevance"), F.min_by("category", "draft_id").alias("category"))


def one_claim(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Each item with the one claim of the lowest priority number; items without a claim are `unsupported_grouping`.

    A hot item has at most as many rows as there are claims on it, folded by a partial aggregate.
    """
    first = claims.groupBy("item_id").agg(F.min_by("claim", F.struct("priority", "claim")).alias("claim"))
    return items.select("item_id").distinct().join(first, "item_id", "left").select("item_id", F.coalesce("claim", F.lit("unsupported_grouping")).alias("claim"))
