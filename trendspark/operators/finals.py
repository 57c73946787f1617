"""Drafts become clusters: heuristic labels, dropping, clusters of one id, scores with history, the ledger of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.functions import normalize as N
from trendspark.functions import prose as P
from trendspark.functions import text as X
from trendspark.operators.drafts import LEAST_RELEVANCE, URLS

def heuristic_relevance(members: DataFrame) -> DataFrame:
    """(draft_id, relevance): 1 to 10 from the mean score of the members and the number of their sources."""
    mean, spread = F.avg("score"), F.least(F.lit(1.0), F.countDistinct("source") / 3)
    raw = F.round(1 + 9 * (0.6 * mean + 0.4 * spread), 6)
    return members.groupBy("draft_id").agg(F.greatest(F.lit(1), F.least(F.lit(10), F.bround(raw, 0).cast("int"))).alias("relevance"))


def heuristic_category(voted: DataFrame, default: str = "News") -> DataFrame:
    """(draft_id, category): votes (draft_id, item_id, score, category, votes) and hints, each worth two, of all members.

    On ties the one met first, the best-scored member first.
    """
    order = F.struct(-F.col("score"), F.col("item_id"))
    n = voted.groupBy("draft_id", "category").agg(F.sum("votes").alias("n"), F.min(F.when(F.col("votes") > 0, order)).alias("first")).where("n > 0")
    best = n.groupBy("draft_id").agg(F.min_by("category", F.struct(-F.col("n"), F.col("first"), F.col("category"))).alias("category"))
    return voted.select("draft_id").distinct().join(best, "draft_id", "left").select("draft_id", F.coalesce("category", F.lit(default)).alias("category"))


def heuristic_summary(context: Column, shown: Column, n_sources: Column, raw_items: Column, subject: Column) -> Column:
    """The first sentence of the best context and how many signals carry it; the flag of no data where there is no context."""
    told = F.element_at(F.split(context, r" \| "), -1)
    first = F.rtrim(F.get(F.split(P.sanitize_summary(told), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), F.lit(0)), F.lit("."))
    verb = F.when(n_sources > 1, L.CARRY[1]).otherwise(L.CARRY[0])
    signals = F.when(raw_items == 1, L.SIGNALS[0]).otherwise(L.SIGNALS[1])
    said = F.concat(first, F.lit(". "), shown, F.lit(" "), verb, F.lit(" "), raw_items.cast("string"), F.lit(" "), signals, F.lit(" "), subject, F.lit("."))
    return F.when(F.coalesce(context, F.lit("")) != "", said).otherwise(L.INSUFFICIENT_FLAG)


def final_reason(drafts: DataFrame) -> DataFrame:
    """drafts (members, n_sources, most_copies, best_score, relevance, headline, summary) with the reason to drop one, or null."""
    lone = (F.col("members") < 2) & (F.col("n_sources") < 2) & (F.col("most_copies") < 2)
    weak = lone & (F.col("best_score") < 0.80) & (F.col("relevance") < 7)
    reason = F.when(P.is_insufficient(F.col("summary"), F.col("headline")), "insufficient_data").when(F.col("relevance") < LEAST_RELEVANCE, "low_relevance")
    return drafts.withColumn("drop_reason", reason.when(weak, "weak_singleton"))


def clusters_of(drafts: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters of the drafts (draft_id, headline, entities, category, relevance) that stay, with what their members say.

    Drafts of one cluster_id are one: what is said is the first's, raw items are added, the relevance is the greatest,
    sources are all, URLS the first URLs by draft, score and item. members: (draft_id, item_id, score, source,
    duplicate_count, url). The items of a cluster are rows of `member_items`.
    """
    named = drafts.withColumn("cluster_id", X.cluster_id(F.col("entities"), F.col("headline")))
    said = named.groupBy("cluster_id").agg(F.min_by("headline", "draft_id").alias("headline"), F.min_by("category", "draft_id").alias("category"), F.max("relevance").alias("relevance"), F.count("*").alias("drafts"))
    held = members.join(named.select("draft_id", "cluster_id"), "draft_id")
    raw = held.groupBy("cluster_id").agg(F.count("*").alias("members"), F.sum(F.greatest(F.lit(1), F.col("duplicate_count"))).alias("raw_items"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    urls = held.where("url <> ''").groupBy("cluster_id", "url").agg(F.min(F.struct("draft_id", -F.col("score"), "item_id")).alias("first"))
    urls = urls.withColumn("nth", F.row_number().over(W.partitionBy("cluster_id").orderBy("first", "url"))).where(F.col("nth") <= URLS)
    urls = urls.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "url"))), lambda s: s["url"]), " ").alias("urls"))
    return said.join(raw, "cluster_id").join(urls, "cluster_id", "left")


def member_items(clusters: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the cluster they are members of, once each; members that are no items go."""
    return members.join(clusters, "draft_id").select("cluster_id", "item_id").distinct().join(items, "item_id")


def scored_with_history(drafts: DataFrame, velocity: DataFrame, relevance_weight: float = 0.6) -> DataFrame:
    """drafts (cluster_id, relevance, velocity by the cold start) with velocity, momentum and score by their history, where known.

    velocity: (cluster_id, velocity, is_new) as of cluster_velocity.
    """
    past = velocity.select("cluster_id", F.col("velocity").alias("__past"), "is_new")
    known = F.col("__past").isNotNull()
    v = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("__past", "velocity"))), 1)
    out = drafts.join(past, "cluster_id", "left").withColumn("velocity", v).withColumn("basis", F.when(known, "historical").otherwise("cold_start"))
    out = out.withColumn("momentum", X.momentum(F.col("velocity"), F.coalesce("is_new", F.lit(False)), ~known))
    combined = F.round(relevance_weight * F.col("relevance") * 10 + (1 - relevance_weight) * F.col("velocity"), 2)
    return out.withColumn("combined", combined).drop("__past", "is_new")


def ledger_entries(cleaned_out: DataFrame, cleaned: DataFrame, candidates: DataFrame, cluster_discards: DataFrame) -> DataFrame:
    """(run_id, stage, reason, n): raw items that each reason took. cleaned_out and cluster_discards: (run_id, item_id, reason);
    cleaned: (run_id, item_id, weight); candidates: (run_id, item_id). Reasons that took none have no row."""
    weights = cleaned.select("run_id", "item_id", F.greatest(F.lit(1), "weight").alias("weight"))
    first = cleaned_out.select("run_id", "reason", F.lit(1).cast("long").alias("weight"))
    left = weights.join(candidates.select("run_id", "item_id").distinct(), ["run_id", "item_id"], "left_anti").select("run_id", F.lit("not_selected_budget").alias("reason"), "weight")
    late = cluster_discards.join(weights, ["run_id", "item_id"], "left").select("run_id", "reason", F.coalesce("weight", F.lit(1)).alias("weight"))
    every = first.unionByName(left).unionByName(late).groupBy("run_id", "reason").agg(F.sum("weight").alias("n"))
    stage = F.create_map(*[F.lit(x) for kv in L.DISCARD_STAGES.items() for x in kv])
    return every.where("n > 0").select("run_id", F.coalesce(F.try_element_at(stage, F.col("reason")), F.lit("other")).alias("stage"), "reason", "n")


def accounting(raw: DataFrame, cleaned: DataFrame, entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """The ledger of each run: what came in, passed, was sent to clustering, is in clusters (by their own raw_items), was discarded.

    unaccounted is what is left over; clean_holds and select_holds say whether the stages agree with one another.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    taken = raw.groupBy("run_id").agg(F.count("*").alias("ingested"))
    passed = cleaned.groupBy("run_id").agg(F.sum(F.greatest(F.lit(1), "weight")).alias("passed"))
    of = lambda stage: F.sum(F.when(F.col("stage") == stage, F.col("n")).otherwise(0))
    gone = entries.groupBy("run_id").agg(F.sum("n").alias("discarded"), of("clean").alias("cleaned_out"), of("select").alias("unselected"))
    held = clusters.groupBy("run_id").agg(F.sum("raw_items").alias("clustered"))
    out = taken.join(passed, "run_id", "left").join(gone, "run_id", "left").join(held, "run_id", "left")
    out = out.select("run_id", "ingested", *map(zero, ("passed", "discarded", "cleaned_out", "unselected", "clustered")))
    out = out.withColumn("candidates", F.col("passed") - F.col("unselected")).withColumn("unaccounted", F.col("ingested") - F.col("discarded") - F.col("clustered"))
    out = out.withColumn("clean_holds", F.col("ingested") - F.col("cleaned_out") == F.col("passed"))
    late = F.col("discarded") - F.col("cleaned_out") - F.col("unselected")
    return out.withColumn("select_holds", F.col("candidates") == F.col("clustered") + late).drop("cleaned_out", "unselected")


def discard_chain(df: DataFrame, greatest_rank: int = 10) -> DataFrame:
    """df (source, title, raw_score, comment_count, subreddit, metrics_verified, rank) with the reason of the first rule of the
    whole chain that fires, null where none does, and the title as it is kept.

    Feed rules come first, generic hashtags are told before a hashtag is taken apart, the rules of titles see the rewritten one.
    """
    source, score, talk = F.col("source"), F.coalesce("raw_score", F.lit(0.0)), F.coalesce("comment_count", F.lit(0))
    verified = F.coalesce("metrics_verified", F.lit(False))
    df = df.withColumn("clean_title", P.rewritten_title(source, F.col("title")))
    title = F.col("clean_title")
    tag = F.lower(F.regexp_replace(F.ltrim(N.normalize_text(F.trim("title")), F.lit("#")), " ", ""))
    generic = tag.isin(*L.GENERIC_HASHTAGS) | tag.rlike(f"^(?:{L.GENERIC_HASHTAG})$")
    alnum = F.regexp_replace(title, "[^A-Za-z0-9]", "")
    reddit, social = source == "reddit", source.isin(*L.SOCIAL)
    reason = (
        F.when(reddit & F.lower(F.coalesce("subreddit", F.lit(""))).isin(*L.LOW_SIGNAL_SUBREDDITS), "reddit_low_signal_subreddit")
        .when(reddit & verified & ((score < 20) | (talk < 5)), "reddit_low_engagement")
        .when(reddit & ~verified & (F.col("rank").isNull() | (F.col("rank") > greatest_rank)), "reddit_unverified_metrics")
        .when((source == "hackernews") & (score < 10), "hn_low_points")
        .when((source == "github") & (score < 20), "github_low_stars")
        .when(source.isin("tiktok", "x_trends24") & generic, "generic_hashtag")
        .when((F.length(alnum) < 2) | alnum.rlike("^[0-9]+$"), "too_short_or_non_ascii")
        .when(source.isin(*L.ANECDOTE_SOURCES) & title.rlike("(?i)" + L.ANECDOTE), "personal_anecdote")
        .when(social & title.rlike("(?i)" + L.MEME_PHOTO), "meme_or_photo")
        .when(social & title.rlike("(?i)" + L.PET), "pet_post")
        .when(~source.isin(*L.NO_BOX_SCORE_SOURCES) & title.rlike("(?i)" + L.BOX_SCORE), "box_score_or_betting")
        .when(social & (F.size(X.significant_tokens(title)) == 0) & ~title.rlike("[A-Z]"), "no_signal_tokens")
    )
    return df.withColumn("discard_reason", reason).withColumn("clean_title", F.when(reason.isNull(), title).otherwise(""))
