"""Queries that finish drafts and keep the ledger of runs, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.functions import prose as P
from trendspark.operators import drafts as D
from trendspark.operators import finals as Z
from trendspark.operators import history as H
from trendspark.operators import labels as V
from trendspark.operators import merging as M
from trendspark.plans.catalogue import _COUNTS, _KEY, _MOMENTUM, _NEAR, _SIG, _list
from trendspark.plans.clusters import _DRAFTS, _MEMBERS, _ROLLUP, _normal, _q
from trendspark.session import materialize, table

#: Titles that set off one rule of the chain each, in its order, some that set off none, and the feed of each.
PLANTED = [
    ("reddit", "A low signal subreddit holds this"),
    ("reddit", "Few people wrote about this"),
    ("reddit", "Deep in a list without numbers"),
    ("hackernews", "Show HN: a parser"),
    ("github", "owner/repo: a tool"),
    ("tiktok", "#fyp"),
    ("x_trends24", "# Sunday Motivation"),
    ("google_news", "7"),
    ("google_news", "My cat learned to open doors"),
    ("tiktok", "Photo of the old bridge"),
    ("x_trends24", "Two dogs at the station"),
    ("google_news", "Best bets for the final"),
    ("tiktok", "and of it"),
    ("arxiv", "Odds of Photo of a cat in best bets"),
    ("google_news", "Parliament passes the water bill"),
    ("hackernews", "Compilers in the browser"),
    ("wikipedia", "Mount   Erebus -- "),
    ("x_trends24", "#earthquake"),
    ("reddit", "Court blocks the merger"),
]


def drafts(s: SparkSession, d: str) -> DataFrame:
    """Orders as drafts of their customer's run: brands of their parts are the entities, in the order of their lines."""
    lines = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    first = lines.groupBy(F.col("l_orderkey").alias("draft_id"), "p_brand").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_linenumber")).alias("first"))
    named = first.groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "p_brand"))), lambda x: x["p_brand"]).alias("entities"))
    rolled = D.rollup(D.members(s, d)).select("draft_id", "members", F.col("llm_relevance").alias("relevance"), "raw_items", "best_score", "sources")
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.col("o_custkey").alias("run_id"), F.concat(F.lit("Orders of "), F.date_format("o_orderdate", "yyyy-MM"), F.lit(" by "), "o_orderpriority").alias("headline"))
    category = D.category_mode(D.members(s, d))
    return orders.join(rolled, "draft_id").join(named, "draft_id").join(category, "draft_id")


def links(s: SparkSession, d: str) -> DataFrame:
    """Drafts of a run that share a supplier."""
    seen = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct().join(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    a, b = seen.alias("a"), seen.alias("b")
    met = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.l_suppkey") == F.col("b.l_suppkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")))
    return met.select(F.col("a.o_orderkey").alias("left_id"), F.col("b.o_orderkey").alias("right_id")).distinct()


_BRANDED = f"""{_ROLLUP}, named AS (SELECT draft_id, list(p_brand ORDER BY first) AS entities FROM (SELECT l_orderkey AS draft_id, p_brand, min((l_partkey, l_suppkey, l_linenumber)) AS first
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) GROUP BY 1),
hints AS (SELECT draft_id, coalesce(hint, 'News') AS category, count(*) AS n, min(item_id) AS first FROM members GROUP BY 1, 2),
modes AS (SELECT draft_id, category FROM hints QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY n DESC, first) = 1),
dr AS (SELECT draft_id, o_custkey AS run_id, 'Orders of ' || strftime(o_orderdate, '%Y-%m') || ' by ' || o_orderpriority AS headline, members, llm_relevance AS relevance, raw_items, best_score, sources, entities, category
  FROM rollup JOIN named USING (draft_id) JOIN modes USING (draft_id) JOIN orders ON o_orderkey = draft_id)"""
_TEXT_KEY = _KEY.replace("title", "e")
#: The list of each run after every step: a run's first pair that merges leaves it, and the merged draft comes to its end.
_MERGE = f"""{_BRANDED}, linked AS (SELECT DISTINCT a.l_orderkey AS l, b.l_orderkey AS r FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey
  JOIN orders x ON x.o_orderkey = a.l_orderkey JOIN orders y ON y.o_orderkey = b.l_orderkey WHERE x.o_custkey = y.o_custkey),
near AS (SELECT l AS draft_id, list(r) AS near FROM linked GROUP BY 1),
state AS (
  SELECT run_id, 0 AS step, row_number() OVER (PARTITION BY run_id ORDER BY draft_id) AS place, [draft_id] AS parts, coalesce(near, []) AS near, members, relevance, category, headline,
    {_KEY.replace("title", "headline")} AS head, list_transform(entities, lambda e: {{'e': e, 'k': {_TEXT_KEY}}}) AS named FROM dr LEFT JOIN near USING (draft_id)
  UNION ALL
  SELECT * FROM (
    WITH keyed AS (SELECT *, list_distinct(list_filter(list_transform(named, lambda n: n.k), lambda k: length(k) >= {M.LEAST_KEY})) AS keys, max(place) OVER (PARTITION BY run_id) + 1 AS last FROM state),
    met AS (SELECT a.run_id, a.place AS i, b.place AS j, a.head = b.head AND a.head <> '' AS same, len(list_intersect(a.keys, b.keys)) AS n, len(a.keys) AS sa, len(b.keys) AS sb, list_has_any(a.near, b.parts) AS linked
      FROM keyed a JOIN keyed b ON a.run_id = b.run_id AND a.place < b.place),
    first AS (SELECT run_id, i, j FROM met WHERE (same OR n > 0 AND 2 * n >= sa + sb - n OR n >= 2 AND n = least(sa, sb)) AND (linked OR sa > 0 AND n = sa AND n = sb OR n >= 2 AND 2 * n >= sa + sb - n)
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY i, j) = 1),
    two AS (SELECT a AS a, b AS b, (b.members, b.relevance) > (a.members, a.relevance) AS turned FROM first f JOIN keyed a ON a.run_id = f.run_id AND a.place = i JOIN keyed b ON b.run_id = f.run_id AND b.place = j),
    led AS (SELECT CASE WHEN turned THEN b ELSE a END AS x, CASE WHEN turned THEN a ELSE b END AS y FROM two)
    SELECT k.run_id, step + 1, place, parts, near, members, relevance, category, headline, head, named FROM keyed k JOIN first f ON k.run_id = f.run_id AND place <> i AND place <> j
    UNION ALL
    SELECT x.run_id, x.step + 1, x.last, list_concat(x.parts, y.parts), list_concat(x.near, y.near), x.members + y.members, greatest(x.relevance, y.relevance), x.category, x.headline, x.head,
      list_filter(list_concat(x.named, y.named), lambda n, nth: n.k <> '' AND list_position(list_transform(list_concat(x.named, y.named), lambda m: m.k), n.k) = nth)[1:{M.ENTITIES}] FROM led)),
done AS (SELECT * FROM state QUALIFY step = max(step) OVER (PARTITION BY run_id))"""


def merging(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Drafts of orders and the drafts that their links lead to; both are written once, for they are read several times."""
    return M.merged(materialize(drafts(s, d), "order-drafts"), materialize(links(s, d), "order-links"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    now, _ = merging(s, d)
    return now.select("run_id", "draft_id", "members", "relevance", "category", "headline", F.array_join("entities", ",").alias("entities"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    """Drafts with a relevance of 7 or more as clusters; those with the same brands are one."""
    kept = materialize(drafts(s, d).where("relevance >= 7"), "order-drafts")
    return Z.clusters_of(kept, materialize(D.members(s, d), "order-members"))


def _members_of(s: SparkSession, d: str) -> DataFrame:
    kept = drafts(s, d).where("relevance >= 9").select("draft_id", F.col("run_id").alias("cluster_id"))
    items = table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_partkey").alias("item_id"))
    return Z.member_items(kept, lines, items)


def _reasons(s: SparkSession, d: str) -> DataFrame:
    k = F.col("draft_id")
    df = drafts(s, d).withColumn("summary", F.when(k % 11 == 0, "[INSUFFICIENT_DATA]").when(k % 13 == 0, "").otherwise("The order was filled on time."))
    df = df.withColumn("n_sources", F.size("sources")).withColumn("most_copies", F.when(k % 2 == 0, F.lit(1)).otherwise(F.col("members")))
    return Z.final_reason(df).select("draft_id", "drop_reason")


def _labels(s: SparkSession, d: str) -> DataFrame:
    """Relevance and category without a model: a line votes for its hint twice, and once for the category of its number."""
    m = D.members(s, d)
    cast = m.select("draft_id", "item_id", "score", F.element_at(F.array(*map(F.lit, L.CATEGORIES)), (F.col("item_id") % len(L.CATEGORIES) + 1).cast("int")).alias("category"), F.lit(1).alias("votes"))
    hints = m.where("hint IS NOT NULL").select("draft_id", "item_id", "score", F.col("hint").alias("category"), F.lit(2).alias("votes"))
    return Z.heuristic_relevance(m).join(Z.heuristic_category(cast.unionByName(hints)), "draft_id")


def _summaries(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 3 + 1
    context = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Title | The order of "), "o_custkey", F.lit(" was filled. More is to come.")))
    said = Z.heuristic_summary(context, F.lit("Reddit"), n, k % 4 + 1, F.concat(F.lit("Brand "), k.cast("string")))
    return table(s, d, "orders").select("o_orderkey", said.alias("summary"), P.is_insufficient(said, F.lit("")).alias("insufficient"))


def _history(s: SparkSession, d: str) -> DataFrame:
    """Drafts scored with the velocity of two entities each, event types, in the newest finished run."""
    runs = materialize(H.runs(s, d), "runs")
    past = materialize(H.velocity(materialize(H.entity_counts(s, d), "counts"), H.nearest_runs(runs, H.windows(s))), "velocities")
    newest = F.broadcast(runs.where("finished").agg(F.max("run_id").alias("run_id")))
    past = past.join(newest, "run_id").select(F.col("entity").alias("entity_key"), "freq", "velocity", (F.col("momentum") == "NEW").alias("is_new"))
    types = table(s, d, "events").select("event_type").distinct().withColumn("nth", F.row_number().over(W.orderBy("event_type")) - 1)  # a few types
    scored = materialize(D.scored(D.rollup(D.members(s, d))).select(F.col("draft_id").alias("cluster_id"), "relevance", "velocity"), "scored-drafts")
    wanted = scored.where("cluster_id % 4 <> 0").select("cluster_id", F.posexplode(F.array(F.col("cluster_id") % 5, F.col("cluster_id") % 3)).alias("ord", "nth"))
    named = wanted.join(F.broadcast(types), "nth").join(F.broadcast(past), F.col("event_type") == F.col("entity_key"))
    return Z.scored_with_history(scored, V.cluster_velocity(named))


def _ledger(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines as raw items of their supplier's run: returned ones and small ones are cleaned out, those of one part are folded,
    a quarter is not selected, two fifths are discarded by clustering, the rest is in clusters."""
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_partkey") * 10_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), "l_partkey", "l_returnflag", "l_quantity")
    reason = F.when(F.col("l_returnflag") == "R", "no_signal_tokens").when(F.col("l_quantity") < 5, "personal_anecdote")
    judged = lines.withColumn("reason", reason)
    out = judged.where("reason IS NOT NULL").select("run_id", "item_id", "reason")
    cleaned = judged.where("reason IS NULL").groupBy("run_id", "l_partkey").agg(F.min("item_id").alias("item_id"), F.count("*").alias("weight")).drop("l_partkey")
    chosen = cleaned.where("item_id % 4 <> 0")
    late = chosen.withColumn("reason", F.when(F.col("item_id") % 5 == 0, "density_noise").when(F.col("item_id") % 5 == 1, "weak_singleton")).where("reason IS NOT NULL").select("run_id", "item_id", "reason")
    clusters = chosen.where("item_id % 5 > 1").groupBy("run_id", (F.col("item_id") % 3).alias("cluster_id")).agg(F.sum("weight").alias("raw_items"))
    return lines, cleaned, Z.ledger_entries(out, cleaned, chosen, late), clusters


def _accounts(s: SparkSession, d: str) -> DataFrame:
    lines, cleaned, entries, clusters = _ledger(s, d)
    return Z.accounting(lines, cleaned, entries, clusters)


def _chain(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    planted = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("title")) for a, b in PLANTED])
    pick = F.element_at(planted, (k % len(PLANTED) + 1).cast("int"))
    of = k % len(PLANTED)
    rows = table(s, d, "orders").select(
        k.alias("item_id"), pick["source"].alias("source"), pick["title"].alias("title"), F.when(of.isin(3, 4), 2.0).otherwise(50.0).alias("raw_score"), F.when(of == 1, 1).otherwise(9).alias("comment_count"),
        F.when(of == 0, "Memes").otherwise("worldnews").alias("subreddit"), (of != 2).alias("metrics_verified"), F.lit(30).alias("rank"),
    )
    return Z.discard_chain(rows).select("item_id", "discard_reason", "clean_title")


_VELOCITIES = f"""{_NEAR}, {_COUNTS}, paced AS (SELECT run_id, entity, freq, total, 100e0 * freq / greatest(1, total) AS rate FROM counts JOIN totals USING (run_id)),
m AS (SELECT n.run_id, n.entity, n.freq, weight, n.rate, coalesce(b.rate, 0e0) AS base, t.total AS ref_total FROM paced n JOIN near ON n.run_id = now_id JOIN totals t ON t.run_id = ref_id LEFT JOIN paced b ON b.run_id = ref_id AND b.entity = n.entity),
v AS (SELECT run_id, entity, freq, round(50 + 50 * sum(weight * tanh((rate - base) / greatest(base, 100e0 / ref_total) / 2)) / sum(weight), 3) AS velocity, max(base) AS most FROM m GROUP BY 1, 2, 3),
now AS (SELECT * FROM v WHERE run_id = (SELECT max(run_id) FROM runs WHERE finished)), types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS nth FROM (SELECT DISTINCT event_type FROM events)),
named AS (SELECT draft_id AS cluster_id, unnest([draft_id % 5, draft_id % 3]) AS nth FROM scored WHERE draft_id % 4 <> 0),
past AS (SELECT cluster_id, round(sum(freq * velocity) / sum(freq), 6) AS past, bool_and(most = 0 AND freq > 0) AS is_new FROM named JOIN types USING (nth) JOIN now ON entity = event_type GROUP BY 1)"""
_LINES = """lines AS (SELECT l_suppkey AS run_id, l_partkey * 10000000 + l_orderkey * 10 + l_linenumber AS item_id, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'no_signal_tokens' WHEN l_quantity < 5 THEN 'personal_anecdote' END AS reason FROM lineitem),
cleaned AS (SELECT run_id, min(item_id) AS item_id, count(*) AS weight FROM lines WHERE reason IS NULL GROUP BY run_id, l_partkey),
entries AS (SELECT run_id, 'clean' AS stage, reason, count(*) AS n FROM lines WHERE reason IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT run_id, 'select', 'not_selected_budget', sum(weight) FROM cleaned WHERE item_id % 4 = 0 GROUP BY 1
  UNION ALL SELECT run_id, 'cluster', CASE item_id % 5 WHEN 0 THEN 'density_noise' ELSE 'weak_singleton' END AS r, sum(weight) FROM cleaned WHERE item_id % 4 <> 0 AND item_id % 5 < 2 GROUP BY 1, r)"""


def _chain_sql() -> str:
    values = ", ".join(f"({i}, {_q(a)}, {_q(b)})" for i, (a, b) in enumerate(PLANTED))
    plain = _normal("title")
    bare = f"CASE WHEN source IN ('x_trends24', 'tiktok') AND starts_with(plain, '#') THEN ltrim(plain, '#') ELSE plain END"
    tag = f"lower(replace(ltrim({_normal('trim(title)')}, '#'), ' ', ''))"
    is_in = lambda c, values: f"list_contains([{_list(values)}], {c})"
    rx = lambda p: f"regexp_matches(t, {_q('(?i)' + p)})"
    sig = _SIG.replace("lower(title)", "lower(t)")
    return f"""WITH planted AS (SELECT * FROM (VALUES {values}) v(nth, source, title)), plain AS (SELECT *, {plain} AS plain, {tag} AS tag FROM planted),
    rewritten AS (SELECT *, trim(regexp_replace(regexp_replace({bare}, {_q('(?i)' + L.CLICKBAIT)}, ' ', 'g'), '\\s+', ' ', 'g'), ' -|:;,') AS t FROM plain),
    judged AS (SELECT nth, t, CASE WHEN nth = 0 THEN 'reddit_low_signal_subreddit' WHEN nth = 1 THEN 'reddit_low_engagement' WHEN nth = 2 THEN 'reddit_unverified_metrics' WHEN nth = 3 THEN 'hn_low_points' WHEN nth = 4 THEN 'github_low_stars'
      WHEN source IN ('tiktok', 'x_trends24') AND ({is_in('tag', L.GENERIC_HASHTAGS)} OR regexp_matches(tag, {_q(f'^(?:{L.GENERIC_HASHTAG})$')})) THEN 'generic_hashtag'
      WHEN length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) < 2 OR regexp_matches(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'), '^[0-9]+$') THEN 'too_short_or_non_ascii'
      WHEN {is_in('source', L.ANECDOTE_SOURCES)} AND {rx(L.ANECDOTE)} THEN 'personal_anecdote' WHEN {is_in('source', L.SOCIAL)} AND {rx(L.MEME_PHOTO)} THEN 'meme_or_photo' WHEN {is_in('source', L.SOCIAL)} AND {rx(L.PET)} THEN 'pet_post'
      WHEN NOT {is_in('source', L.NO_BOX_SCORE_SOURCES)} AND {rx(L.BOX_SCORE)} THEN 'box_score_or_betting' WHEN {is_in('source', L.SOCIAL)} AND len({sig}) = 0 AND NOT regexp_matches(t, '[A-Z]') THEN 'no_signal_tokens' END AS discard_reason FROM rewritten)
    SELECT o_orderkey AS item_id, discard_reason, CASE WHEN discard_reason IS NULL THEN t ELSE '' END AS clean_title FROM orders JOIN judged ON nth = o_orderkey % {len(PLANTED)}"""


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    momentum = _MOMENTUM.replace("velocity", "shown")
    return {
        "draft_merge_groups": (lambda s, d: merging(s, d)[1], f"WITH RECURSIVE {_MERGE} SELECT unnest(parts) AS draft_id, list_min(parts) AS root FROM done"),
        "merged_drafts": (
            _merged,
            f"""WITH RECURSIVE {_MERGE} SELECT run_id, list_min(parts) AS draft_id, CAST(members AS BIGINT) AS members, relevance, category, headline,
            array_to_string(list_transform(named, lambda n: n.e), ',') AS entities FROM done""",
        ),
        "final_clusters": (
            _clusters,
            f"""WITH {_BRANDED}, called AS (SELECT *, substr(sha1(array_to_string(list_sort(list_distinct(list_transform(entities, lambda e: lower(trim(e))))), '|')), 1, 12) AS cluster_id FROM dr WHERE relevance >= 7),
            held AS (SELECT m.*, cluster_id FROM members m JOIN called USING (draft_id)), seen AS (SELECT cluster_id, url, min((draft_id, -score, item_id)) AS first FROM held GROUP BY 1, 2),
            shown AS (SELECT cluster_id, string_agg(url, ' ' ORDER BY first, url) AS urls FROM (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY first, url) <= {D.URLS}) GROUP BY 1),
            raw AS (SELECT cluster_id, count(*) AS members, CAST(sum(greatest(1, duplicate_count)) AS BIGINT) AS raw_items, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM held GROUP BY 1),
            said AS (SELECT cluster_id, min_by(headline, draft_id) AS headline, min_by(category, draft_id) AS category, max(relevance) AS relevance, count(*) AS drafts FROM called GROUP BY 1)
            SELECT * FROM said JOIN raw USING (cluster_id) LEFT JOIN shown USING (cluster_id)""",
        ),
        "cluster_members": (
            _members_of,
            f"""WITH {_ROLLUP} SELECT DISTINCT o_custkey AS cluster_id, l_partkey AS item_id, p_name AS title FROM rollup JOIN orders ON o_orderkey = draft_id JOIN lineitem ON l_orderkey = draft_id JOIN part ON p_partkey = l_partkey WHERE llm_relevance >= 9""",
        ),
        "final_drop_reason": (
            _reasons,
            f"""WITH {_ROLLUP} SELECT draft_id, CASE WHEN draft_id % 11 = 0 OR draft_id % 13 = 0 THEN 'insufficient_data' WHEN llm_relevance < {D.LEAST_RELEVANCE} THEN 'low_relevance'
            WHEN members < 2 AND len(sources) < 2 AND (draft_id % 2 = 0 OR members < 2) AND best_score < 0.80e0 AND llm_relevance < 7 THEN 'weak_singleton' END AS drop_reason FROM rollup JOIN orders ON o_orderkey = draft_id""",
        ),
        "heuristic_labels": (
            _labels,
            f"""WITH {_MEMBERS}, rel AS (SELECT draft_id, CAST(greatest(1, least(10, round_even(round(1 + 9 * (0.6e0 * avg(score) + 0.4e0 * least(1e0, count(DISTINCT source) / 3e0)), 6), 0))) AS INT) AS relevance FROM members GROUP BY 1),
            votes AS (SELECT draft_id, item_id, score, ([{_list(L.CATEGORIES)}])[item_id % {len(L.CATEGORIES)} + 1] AS category, 1 AS v FROM members UNION ALL SELECT draft_id, item_id, score, hint, 2 FROM members WHERE hint IS NOT NULL),
            n AS (SELECT draft_id, category, sum(v) AS n, min((-score, item_id)) AS first FROM votes GROUP BY 1, 2)
            SELECT draft_id, relevance, category FROM rel JOIN (SELECT draft_id, category FROM n QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY n DESC, first, category) = 1) USING (draft_id)""",
        ),
        "heuristic_summary": (
            _summaries,
            """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '[INSUFFICIENT_DATA]' ELSE 'The order of ' || o_custkey || ' was filled. Reddit ' || CASE WHEN o_orderkey % 3 = 0 THEN 'is' ELSE 'are' END || ' carrying ' || (o_orderkey % 4 + 1)
            || ' related signal' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 's' END || ' about Brand ' || o_orderkey || '.' END AS summary, o_orderkey % 5 = 0 AS insufficient FROM orders""",
        ),
        "scores_with_history": (
            _history,
            f"""WITH {_DRAFTS}, {_VELOCITIES}, s AS (SELECT draft_id AS cluster_id, relevance, round(greatest(0e0, least(100e0, coalesce(past, scored.velocity))), 1) AS shown, past IS NOT NULL AS known, coalesce(is_new, false) AS is_new FROM scored LEFT JOIN past ON cluster_id = draft_id)
            SELECT cluster_id, relevance, shown AS velocity, CASE WHEN known THEN 'historical' ELSE 'cold_start' END AS basis, CASE WHEN NOT known THEN 'BASELINE' WHEN is_new THEN 'NEW'{momentum} ELSE 'FADING' END AS momentum, round(0.6e0 * relevance * 10 + 0.4e0 * shown, 2) AS combined FROM s""",
        ),
        "run_ledger": (lambda s, d: _ledger(s, d)[2], f"WITH {_LINES} SELECT run_id, stage, reason, CAST(n AS BIGINT) AS n FROM entries"),
        "run_accounting": (
            _accounts,
            f"""WITH {_LINES}, taken AS (SELECT run_id, count(*) AS ingested FROM lines GROUP BY 1), passed AS (SELECT run_id, sum(weight) AS passed FROM cleaned GROUP BY 1),
            gone AS (SELECT run_id, sum(n) AS discarded, sum(n) FILTER (stage = 'clean') AS c, sum(n) FILTER (stage = 'select') AS u FROM entries GROUP BY 1), held AS (SELECT run_id, sum(weight) AS clustered FROM cleaned WHERE item_id % 4 <> 0 AND item_id % 5 > 1 GROUP BY 1),
            a AS (SELECT run_id, ingested, CAST(coalesce(passed, 0) AS BIGINT) AS passed, CAST(coalesce(discarded, 0) AS BIGINT) AS discarded, CAST(coalesce(clustered, 0) AS BIGINT) AS clustered, CAST(coalesce(c, 0) AS BIGINT) AS c, CAST(coalesce(u, 0) AS BIGINT) AS u
              FROM taken LEFT JOIN passed USING (run_id) LEFT JOIN gone USING (run_id) LEFT JOIN held USING (run_id))
            SELECT run_id, ingested, passed, discarded, clustered, passed - u AS candidates, ingested - discarded - clustered AS unaccounted, ingested - c = passed AS clean_holds, passed - u = clustered + discarded - c - u AS select_holds FROM a""",
        ),
        "discard_chain": (_chain, _chain_sql()),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items()}
