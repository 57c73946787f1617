"""A run from its candidates to clusters and discards: groups, labels, coherence, homes of orphans, merging, finishing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import normalize as N
from trendspark.functions import prose as P
from trendspark.functions import text as X
from trendspark.operators import finals as Z
from trendspark.operators import labelling as B
from trendspark.operators import labels as V
from trendspark.operators import links as K
from trendspark.operators import merging as M
from trendspark.operators.drafts import category_mode
from trendspark.operators.stages import Stages
from trendspark.session import materialize

HEADLINE_WORDS, LEAD_CHARS, KEEP_SCORE = 10, 100, 0.80
_LABELLED = ("headline", "category", "entities", "summary", "relevance")


def _order() -> Column:
    return F.struct(-F.col("score"), F.col("item_id"))


def heuristic_drafts(members: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(draft_id, headline, category, entities, summary, relevance) of drafts, told by their members alone.

    members: draft_id, item_id, source, title, score, hint, context, duplicate_count. The headline is the title that says most,
    the category that of most votes and hints, the summary the first sentence of the best member's context and how many
    signals carry it (the flag of no data where no member has a context), the relevance from scores and sources.
    """
    best = F.min_by("title", _order())
    said = F.coalesce("context", F.lit("")) != ""
    rolled = members.groupBy("draft_id").agg(
        F.sum(F.greatest(F.lit(1), F.coalesce("duplicate_count", F.lit(1)))).alias("raw_items"), F.array_sort(F.collect_set("source")).alias("sources"),
        best.alias("lead"), F.min_by("context", F.when(said, _order())).alias("told"),
    )
    names = V.draft_entities(members).groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "entity"))), lambda s: s["entity"]).alias("entities"))
    category = V.draft_category(V.category_votes(members, patterns), _order())
    all_of = rolled.join(names, "draft_id", "left").join(category, "draft_id").join(V.best_title(members), "draft_id").join(Z.heuristic_relevance(members), "draft_id")
    all_of = all_of.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    subject = F.coalesce(F.nullif(F.array_join(F.slice("entities", 1, 3), ", "), F.lit("")), F.substring("lead", 1, 80))
    summary = Z.heuristic_summary(F.col("told"), N.display_sources(F.col("sources")), F.size("sources"), F.col("raw_items"), subject)
    return all_of.select("draft_id", F.substring("title", 1, LEAD_CHARS).alias("headline"), "category", "entities", summary.alias("summary"), "relevance")


@dataclass
class Clustered:
    """clusters: as finals.clusters_of, with summary and entities; members: (cluster_id, item_id); discards: (item_id, reason).

    Every candidate is a member of one cluster or has one reason.
    """

    clusters: DataFrame
    members: DataFrame
    discards: DataFrame


def _keys(drafts: DataFrame) -> DataFrame:
    return drafts.select("draft_id", F.explode("entities").alias("entity")).select("draft_id", X.dedupe_key(F.col("entity")).alias("entity_key")).distinct()


def _unlabelled(members: DataFrame, place: Column) -> DataFrame:
    nothing = [F.lit("").alias("headline"), F.lit("").alias("category"), F.array().cast("array<string>").alias("entities"), F.lit("").alias("summary"), F.lit(5).alias("relevance")]
    return members.groupBy("draft_id").agg(place.alias("place")).select(F.lit(0).alias("run_id"), "draft_id", "place", F.lit(True).alias("needs_label"), *nothing)


def coherent(drafts: DataFrame, members: DataFrame, items: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """drafts, members and orphans (run_id, item_id, nth) after drafts whose members don't hang together are taken apart.

    A draft keeps its one core, with its label unless that core lost more than a third; several cores are drafts without a
    label, in the order of their sizes. Entities that no member names go; a draft that keeps less than half of them, or has
    a headline of umbrella words, needs a new label.
    """
    held = members.join(items, "item_id").select("draft_id", "item_id", "told", "text_key")
    outcome = K.coherence(K.draft_components(held, _keys(drafts), "told", corpus=corpus))
    outcome = materialize(outcome.join(members.select("draft_id", "item_id", "place"), ["draft_id", "item_id"]), "coherence")
    stays = outcome.where("outcome <> 'orphan'")
    now = stays.select(F.col("home").alias("draft_id"), "item_id", "place")
    new = stays.groupBy("home").agg(F.min("draft_id").alias("was"), F.bool_or("relabel").alias("relabel"), F.bool_or(F.col("outcome") == "split").alias("split"), F.count("*").alias("size"))
    d = drafts.withColumnRenamed("draft_id", "was").join(new, "was")
    rank = F.row_number().over(W.partitionBy("run_id").orderBy("place", F.desc("size"), "home"))  # a run's drafts
    blank = {"headline": F.lit(""), "category": F.lit(""), "entities": F.array().cast("array<string>"), "summary": F.lit(""), "relevance": F.lit(5)}
    said = [F.when(F.col("split"), blank[c]).otherwise(F.col(c)).alias(c) for c in _LABELLED]
    d = d.select("run_id", F.col("home").alias("draft_id"), rank.alias("place"), F.col("relabel").alias("needs_label"), *said)
    d = materialize(d.withColumn("clean", P.sanitize_headline(F.col("headline"), HEADLINE_WORDS)), "taken-apart")
    inside = now.join(items, "item_id").select("draft_id", "item_id", "told", "text_key")
    good = K.grounded(inside, _keys(d), "told").groupBy("draft_id").agg(F.collect_set("entity_key").alias("good"))
    kept = F.filter("entities", lambda e: F.array_contains(F.coalesce("good", F.array().cast("array<string>")), X.dedupe_key(e)))
    d = d.join(good, "draft_id", "left").withColumn("kept", kept)
    umbrella = (F.col("headline") != "") & N.is_generic_headline(F.col("clean"))
    again = F.col("needs_label") | ((F.size("entities") > 0) & (F.size("kept") * 2 < F.size("entities"))) | umbrella
    d = d.select("run_id", "draft_id", "place", again.alias("needs_label"), *(F.col("kept").alias(c) if c == "entities" else F.col(c) for c in _LABELLED))
    at = F.row_number().over(W.orderBy("place", "item_id"))  # one run's orphans
    orphans = outcome.where("outcome = 'orphan'").select("item_id", F.col("draft_id").alias("was")).join(drafts.select(F.col("draft_id").alias("was"), "run_id", "place"), "was").select("run_id", "item_id", at.alias("nth"))
    return d, now, orphans


def finished(drafts: DataFrame, members: DataFrame, items: DataFrame, patterns: dict[str, str]) -> Clustered:
    """Clusters of drafts (draft_id, their order, and what is said of them), and the reasons of those that are dropped.

    The category is held against hints and votes of the members; a headline of umbrella words and entities that are no names
    give way to what the members' titles say; the summary has two sentences.
    """
    held = materialize(members.select("draft_id", "item_id").join(items, "item_id"), "final-members")
    rolled = held.groupBy("draft_id").agg(
        F.count("*").alias("members"), F.countDistinct("source").alias("n_sources"), F.max("duplicate_count").alias("most_copies"), F.max("score").alias("best_score"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    judged = materialize(Z.final_reason(drafts.join(rolled, "draft_id")), "judged")
    dropped = held.join(judged.where("drop_reason IS NOT NULL").select("draft_id", F.col("drop_reason").alias("reason")), "draft_id").select("item_id", "reason")
    stays = judged.where("drop_reason IS NULL").drop("drop_reason")
    voted = materialize(V.category_votes(held.withColumn("voting", F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))), patterns, "voting"), "voted")
    mode = category_mode(held.withColumn("hint", F.coalesce("hint", "inferred"))).withColumnRenamed("category", "mode")
    proposed = stays.join(mode, "draft_id").select("draft_id", F.coalesce(F.nullif(N.coerce_category(F.col("category"), ""), F.lit("")), "mode").alias("proposed"))
    guarded = V.guarded_category(proposed, voted)
    titles = V.best_title(held).select("draft_id", P.sanitize_headline(F.col("title"), HEADLINE_WORDS).alias("best"))
    names = V.draft_entities(held).groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "entity"))), lambda s: s["entity"]).alias("names"))
    full = stays.drop("category").join(guarded, "draft_id").join(titles, "draft_id").join(names, "draft_id", "left")
    # Written between the steps: each is a long expression, and as one they would not compile.
    own, found = P.clean_entities(F.col("entities")), P.clean_entities(F.coalesce("names", F.array().cast("array<string>")))
    full = materialize(full.withColumn("headline", P.sanitize_headline(F.col("headline"), HEADLINE_WORDS)).withColumn("entities", own).withColumn("names", found), "cleaned-labels")
    full = full.withColumn("headline", F.when((F.col("headline") == "") | N.is_generic_headline(F.col("headline")), F.col("best")).otherwise(F.col("headline")))
    full = materialize(full.withColumn("entities", F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.col("names"))), "final-labels")
    full = full.withColumn("summary", P.two_sentences(F.col("summary"), F.col("sources"), F.col("headline"), F.col("entities"))).withColumn("cluster_id", X.cluster_id(F.col("entities"), F.col("headline")))
    full = materialize(full, "final-drafts")
    clusters = Z.clusters_of(full.select("draft_id", "headline", "entities", "category", "relevance"), held.select("draft_id", "item_id", "score", "source", "duplicate_count", "url"))
    told = full.groupBy("cluster_id").agg(F.min_by("summary", "draft_id").alias("summary"), F.min_by("entities", "draft_id").alias("entities"))
    return Clustered(clusters.join(told, "cluster_id"), held.join(full.select("draft_id", "cluster_id"), "draft_id").select("cluster_id", "item_id"), dropped)


def cluster(items: DataFrame, corpus: DataFrame, patterns: dict[str, str], stages: Stages, groups: DataFrame | None = None, provider: B.Provider | None = None, keep_top: bool = False) -> Clustered:
    """The candidates of one run as clusters and discards; each stage is a table of `stages`.

    items: item_id, source, title, told (the title with what names entities beside it), score, url, hint, inferred,
    description, context, duplicate_count, line; corpus: item_id and told of all cleaned items of the run. groups: (item_id,
    group_id, place) of two and more, where vectors are at hand; shared tokens of titles without it. provider labels drafts;
    without it they are told by their members. keep_top makes drafts of lone items with a score of KEEP_SCORE.
    """
    items = stages("candidates", lambda: items.withColumn("text_key", X.dedupe_key(F.col("told"))))
    pool = stages("corpus", lambda: corpus.select("item_id", "told").unionByName(items.select("item_id", "told")).dropDuplicates(["item_id"]).withColumn("text_key", X.dedupe_key(F.col("told"))))

    def grouped() -> DataFrame:
        found = K.lexical_groups(items).select("item_id", "group_id", F.col("item_id").alias("place")) if groups is None else groups
        n = found.groupBy("group_id").agg(F.count("*").alias("n"), F.min("item_id").alias("draft_id"))
        several = found.join(n.where("n >= 2"), "group_id").select("draft_id", "item_id", F.col("place").cast("long").alias("place"))
        if not keep_top:
            return several
        alone = items.where(F.col("score") >= KEEP_SCORE).join(several.select("item_id"), "item_id", "left_anti")
        return several.unionByName(alone.select(F.col("item_id").alias("draft_id"), "item_id", F.lit(0).cast("long").alias("place")))

    members = stages("groups", grouped)
    noise = items.join(members.select("item_id"), "item_id", "left_anti").select("item_id", F.lit("density_noise").alias("reason"))
    told = lambda m: heuristic_drafts(m.select("draft_id", "item_id").join(items, "item_id"), patterns)
    links = stages("links", lambda: K.linked(K.shared_tokens(items.select("item_id", "told", F.lit(0).alias("run")), "told", "run", corpus=pool)).select("left_id", "right_id"))

    def labelled(drafts: DataFrame, members: DataFrame, orphans: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """drafts, members and orphans after the drafts that need a label, or have no headline, got one."""
        drafts = drafts.withColumn("needs_label", F.col("needs_label") | (F.col("headline") == ""))
        if provider:
            made: list[B.Relabelled] = []

            def once() -> B.Relabelled:
                if not made:
                    made.append(B.relabel(drafts, members, orphans, items, links, provider, told, "told"))
                return made[0]

            return stages(f"{name}-drafts", lambda: once().drafts), stages(f"{name}-members", lambda: once().members), stages(f"{name}-orphans", lambda: once().orphans)

        def plain() -> DataFrame:
            new = told(members.join(drafts.where("needs_label"), "draft_id", "left_semi")).select("draft_id", *(F.col(c).alias(f"_{c}") for c in _LABELLED))
            said = [F.when(F.col("needs_label"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _LABELLED]
            return drafts.join(new, "draft_id", "left").select("run_id", "draft_id", "place", F.lit(False).alias("needs_label"), *said)

        return stages(f"{name}-drafts", plain), members, orphans

    nobody = items.select(F.lit(0).alias("run_id"), "item_id", F.lit(0).alias("nth")).where("false")
    drafts, members, _ = labelled(_unlabelled(members, F.min("item_id")), members, nobody, "first")
    apart = None

    def taken_apart() -> tuple[DataFrame, DataFrame, DataFrame]:
        nonlocal apart
        apart = apart or coherent(drafts, members, items, pool)
        return apart

    now, held = stages("coherent-drafts", lambda: taken_apart()[0]), stages("coherent-members", lambda: taken_apart()[1])
    orphans = stages("orphans", lambda: taken_apart()[2])
    now, held, orphans = labelled(now, held, orphans, "second")
    homes = stages("homes", lambda: K.rehomed(orphans.join(items, "item_id").select("item_id", "text_key"), _keys(now)))
    lost = orphans.join(homes, "item_id", "left_anti").select("item_id", F.lit("unsupported_grouping").alias("reason"))
    held = held.select("draft_id", "item_id").unionByName(homes.select("draft_id", "item_id"))

    def merging() -> DataFrame:
        size = held.groupBy("draft_id").agg(F.count("*").alias("members"))
        listed = now.join(size, "draft_id").withColumn("category", N.coerce_category(F.col("category")))
        home = held.select("draft_id", "item_id")
        ends = links.join(home.select(F.col("item_id").alias("left_id"), F.col("draft_id").alias("l")), "left_id").join(home.select(F.col("item_id").alias("right_id"), F.col("draft_id").alias("r")), "right_id")
        done, root = M.merged(listed, ends.where("l <> r").select(F.col("l").alias("left_id"), F.col("r").alias("right_id")).distinct(), "place")
        done = done.join(now.select(F.col("draft_id").alias("lead_id"), "summary"), "lead_id")
        return root.join(done.withColumnRenamed("draft_id", "root"), "root")

    merged = stages("merged", merging)
    final = merged.dropDuplicates(["root"]).select(F.col("place").alias("draft_id"), "relevance", "category", "headline", "entities", "summary")
    inside = held.join(merged.select("draft_id", F.col("place").alias("final_id")), "draft_id").select(F.col("final_id").alias("draft_id"), "item_id")
    out = finished(final, inside, items, patterns)
    return Clustered(stages("clusters", lambda: out.clusters), stages("cluster-members", lambda: out.members), stages("discards", lambda: noise.unionByName(lost).unionByName(out.discards)))
