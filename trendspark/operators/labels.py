"""Categories by votes of a word list, entities and titles of drafts, velocity of drafts, snapshots and question matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import prose as P
from trendspark.functions import text as X
from trendspark.functions.lexicon import CLAIMABLE, PREFERRED, PRIORITIES, TREND_REF


def category_votes(items: DataFrame, patterns: dict[str, str], text: str = "title") -> DataFrame:
    """items with `votes`, the matches of each category's pattern in the text, by category, and the category of most votes.

    The word list is the caller's: one pattern a category. Ties go to the order PREFERRED; no match gives no category.
    """
    names = [c for c in PREFERRED if c in patterns]
    count = lambda c: F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(patterns[c]))
    out = items.withColumn("votes", F.create_map(*[x for c in names for x in (F.lit(c), count(c))]))
    best = F.array_max(F.map_values("votes"))
    first = F.get(F.filter(F.array(*map(F.lit, names)), lambda c: F.element_at("votes", c) == best), F.lit(0))
    return out.withColumn("inferred", F.when(best > 0, first))


def draft_votes(voted: DataFrame, hint_weight: int = 0) -> DataFrame:
    """(draft_id, category, votes): votes of all members, and hint_weight for each hint. Zero votes yield no row."""
    cast = voted.select("draft_id", "item_id", F.explode("votes").alias("category", "n"))
    hints = voted.where("hint IS NOT NULL").select("draft_id", "item_id", F.col("hint").alias("category"), F.lit(hint_weight).alias("n"))
    return cast.unionByName(hints).groupBy("draft_id", "category").agg(F.sum("n").alias("votes"), F.min(F.when(F.col("n") > 0, F.col("item_id"))).alias("first")).where("votes > 0")


def draft_category(voted: DataFrame, order: Column, hint_weight: int = 2) -> DataFrame:
    """(draft_id, category): the category of most votes, each hint of a member worth hint_weight; News without votes.

    Ties go to the category met first: members in the given order, in each the categories of the word list, then its hint.
    """
    pos = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("category"))
    cast = voted.select("draft_id", order.alias("at"), F.explode("votes").alias("category", "n")).select("draft_id", "at", pos.alias("pos"), "category", "n")
    hint = voted.where("hint IS NOT NULL").select("draft_id", order.alias("at"), F.lit(len(PREFERRED) + 1).cast("long").alias("pos"), F.col("hint").alias("category"), F.lit(hint_weight).alias("n"))
    met = F.min(F.struct("at", "pos")).alias("met")
    votes = cast.unionByName(hint).where("n > 0").groupBy("draft_id", "category").agg(F.sum("n").alias("n"), met)
    best = votes.groupBy("draft_id").agg(F.min_by("category", F.struct(-F.col("n"), "met")).alias("category"))
    return voted.select("draft_id").distinct().join(best, "draft_id", "left").select("draft_id", F.coalesce("category", F.lit("News")).alias("category"))


def guarded_category(proposed: DataFrame, voted: DataFrame) -> DataFrame:
    """(draft_id, category): the proposed category unless members speak against it.

    Members of paper feeds alone make Science & AI. A technical category that no member hints at goes to the most voted
    other one if nothing votes for it or that one has twice its votes (without other votes to the most frequent other hint,
    else News); sport that nothing supports goes to the category of most votes, if two. Ties go to the first member's.
    """
    technical = F.col("category").isin("Tech", "Science & AI")
    top = lambda n, when: F.max_by(F.when(when, F.col("category")), F.when(when, F.struct(F.col(n), -F.col("first"), F.col("category"))))
    votes = draft_votes(voted).groupBy("draft_id").agg(
        F.sum(F.when(technical, F.col("votes")).otherwise(0)).alias("tech_votes"), F.max(F.when(~technical, F.col("votes"))).alias("other_votes"), top("votes", ~technical).alias("other"),
        F.max("votes").alias("top_votes"), top("votes", F.lit(True)).alias("top"), F.sum(F.when(F.col("category") == "Sports", F.col("votes")).otherwise(0)).alias("sport_votes"),
    )
    hints = voted.where("hint IS NOT NULL").groupBy("draft_id", F.col("hint").alias("category")).agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    hints = hints.groupBy("draft_id").agg(F.sum(F.when(technical, F.col("n")).otherwise(0)).alias("tech_hints"), top("n", ~technical).alias("other_hint"), F.count_if(F.col("category") == "Sports").alias("sport_hints"))
    feeds = voted.groupBy("draft_id").agg(F.bool_and(F.col("source").isin("arxiv", "ai_papers")).alias("papers"))
    all_of = proposed.join(feeds, "draft_id").join(votes, "draft_id", "left").join(hints, "draft_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    off = F.col("proposed").isin("Tech", "Science & AI") & (zero("tech_hints") == 0) & ((zero("tech_votes") == 0) | (zero("other_votes") >= 2 * zero("tech_votes")))
    no_sport = (F.col("proposed") == "Sports") & (zero("sport_votes") == 0) & (zero("sport_hints") == 0) & (zero("top_votes") >= 2)
    category = F.when(F.col("papers"), "Science & AI").when(off, F.coalesce("other", "other_hint", F.lit("News"))).when(no_sport, F.col("top")).otherwise(F.col("proposed"))
    return all_of.select("draft_id", category.alias("category"))


def draft_entities(members: DataFrame, limit: int = 5, title: str = "title") -> DataFrame:
    """(draft_id, entity, n, nth): the most frequent names in the titles of a draft, the one met first on ties."""
    met = members.select("draft_id", "item_id", F.posexplode(P.proper_nouns(F.col(title))).alias("pos", "entity"))
    counted = met.groupBy("draft_id", "entity").agg(F.count("*").alias("n"), F.min(F.struct("item_id", "pos")).alias("first"))
    nth = F.row_number().over(W.partitionBy("draft_id").orderBy(F.desc("n"), "first", "entity"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= limit).select("draft_id", "entity", "n", "nth")


def best_title(members: DataFrame, shown: int = 6) -> DataFrame:
    """(draft_id, title): of the six best-scored members the title that says most; one in lower case as a title."""
    nth = F.row_number().over(W.partitionBy("draft_id").orderBy(F.desc("score"), "item_id"))
    top = members.withColumn("nth", nth).where(F.col("nth") <= shown)
    n = F.size(X.significant_tokens(F.col("title")))
    worth = F.col("score") + 0.04 * F.least(n, F.lit(8)) - F.when(n < 2, 0.3).otherwise(0.0)
    best = top.groupBy("draft_id").agg(F.max_by("title", F.struct(F.round(worth, 9), -F.col("nth"))).alias("title"))
    lower = (F.col("title") == F.lower("title")) & F.col("title").rlike("[a-z]")
    return best.withColumn("title", F.when(lower, F.initcap("title")).otherwise(F.col("title")))


def cluster_velocity(entities: DataFrame) -> DataFrame:
    """Velocity of clusters by (cluster_id, entity_key, ord, freq, velocity, is_new): the mean by frequency over entities with
    history, the entity whose windows are shown (most frequent, first on ties), and whether all are new."""
    with_history = entities.where("velocity IS NOT NULL")
    return with_history.groupBy("cluster_id").agg(
        F.round(F.sum(F.col("freq") * F.col("velocity")) / F.nullif(F.sum("freq"), F.lit(0)), 6).alias("velocity"), F.max_by("entity_key", F.struct("freq", -F.col("ord"))).alias("shown"), F.bool_and("is_new").alias("is_new"),
    )


def with_headline_entity(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """entities (cluster_id, entity), and for clusters (cluster_id, headline) without any what follows the last colon of the headline."""
    bare = clusters.join(entities.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return entities.select("cluster_id", "entity").unionByName(bare.select("cluster_id", F.trim(F.substring_index("headline", ":", -1)).alias("entity")))


def newest_snapshot(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """The newer of the newest local and the newest cloud run; a tie goes to the cloud."""
    both = local.withColumn("is_cloud", F.lit(False)).unionByName(cloud.withColumn("is_cloud", F.lit(True)))
    return both.orderBy(F.desc("started_at"), F.desc("is_cloud"), "run_id").limit(1)


def question_matches(questions: DataFrame, trends: DataFrame, limit: int = 2) -> DataFrame:
    """(question_id, rank, nth): the trends (rank, headline, entities) that each question is about.

    Ranks it names, in its order; else trends of two tokens in common or with an entity in it, by tokens plus 2 if named, the
    later rank on ties. trends are one report, some tens of rows, and are broadcast.
    """
    refs = F.transform(F.regexp_extract_all(F.lower("question"), F.lit(TREND_REF), F.lit(1)), lambda r: r.cast("int"))
    one = F.broadcast(trends.agg(F.count("*").alias("n")))
    asked = questions.join(one).withColumn("refs", F.array_distinct(F.filter(refs, lambda r: (r >= 1) & (r <= F.col("n")))))
    direct = asked.where(F.size("refs") > 0).select("question_id", F.posexplode("refs").alias("pos", "rank")).select("question_id", "rank", (F.col("pos") + 1).alias("nth"))
    t = F.broadcast(trends.select("rank", "entities", X.significant_tokens(F.col("headline")).alias("tokens")))
    met = asked.where(F.size("refs") == 0).select("question_id", F.lower("question").alias("low"), X.significant_tokens(F.col("question")).alias("asked"))
    met = met.join(t, F.arrays_overlap("asked", "tokens") | F.exists("entities", lambda e: (F.length(e) >= 3) & F.contains(F.col("low"), F.lower(e))))
    named = F.exists("entities", lambda e: (F.length(e) >= 3) & F.contains(F.col("low"), F.lower(e)))
    overlap = F.size(F.array_intersect("asked", "tokens"))
    scored = met.where((overlap >= 2) | named).select("question_id", "rank", (overlap + F.when(named, 2).otherwise(0)).alias("score"))
    scored = scored.withColumn("nth", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("rank"))))
    return direct.unionByName(scored.select("question_id", "rank", "nth")).where(F.col("nth") <= limit)


def claimable_tickets(tickets: DataFrame, run_id: str) -> DataFrame:
    """Tickets that may be claimed, with their place: those in progress, then by priority, then the oldest."""
    free = F.col("status").isin(*CLAIMABLE) & F.coalesce("dependency_ready", F.lit(True)) & F.coalesce(F.col("active_run") == run_id, F.lit(True))
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), F.coalesce("priority", F.lit("medium"))), F.lit(2))
    return tickets.where(free).orderBy(F.col("status") != "in_progress", priority, F.coalesce("updated_at", F.lit("")), "ticket_id")
