"""Queries over links, names, votes and drafts of titles, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.functions import normalize as N
from trendspark.functions import text as X
from trendspark.operators import groups as G
from trendspark.operators import history as H
from trendspark.operators import items as I
from trendspark.operators import labels as V
from trendspark.operators import links as K
from trendspark.plans.catalogue import _COUNTS, _ITEMS, _KEY, _MOMENTUM, _NEAR, _SIG, _list
from trendspark.plans.clusters import _normal, _q
from trendspark.session import materialize, table

#: Items in a row that make a draft, and a word list for the invented prose of the test tables.
DRAFT, PATTERNS = 8, {"Sports": r"\bth[a-z]*", "Tech": r"\b(?:in|on)[a-z]+", "News": r"\b(?:der|les?)\b", "Science & AI": r"\b[a-z]+tion\b"}

_D = f"""{_ITEMS}, clean AS (SELECT item_id, source, raw_score AS score, {_normal('title')} AS title, (item_id - 1) // {DRAFT} AS draft_id FROM items),
mem AS (SELECT *, {_KEY} AS text_key, {_SIG} AS tokens FROM clean)"""
_TOK = f"""{_D}, words AS (SELECT item_id, draft_id, len(tokens) AS size, unnest(tokens) AS token FROM mem),
caps AS (SELECT greatest(4, floor(0.06e0 * n)) AS rare_cap, greatest(6, floor(0.10e0 * n)) AS short_cap FROM (SELECT count(*) AS n FROM mem)),
dfs AS (SELECT token, count(*) AS df FROM words GROUP BY 1), tok AS (SELECT w.*, df, rare_cap, short_cap, greatest(short_cap, 12) AS join_cap FROM words w JOIN dfs USING (token) CROSS JOIN caps)"""


def _pairs(on: str, where: str) -> str:
    return f"""met AS (SELECT a.item_id AS l, b.item_id AS r, count(*) FILTER (a.df <= a.rare_cap) AS rare, count(*) FILTER (a.df <= a.short_cap) AS few, coalesce(max(length(a.token)) FILTER (a.df <= a.rare_cap), 0) AS longest
  FROM tok a JOIN tok b ON a.token = b.token AND a.item_id < b.item_id {on} GROUP BY 1, 2),
pairs AS (SELECT l, r, rare, few, longest, len(list_intersect(x.tokens, y.tokens)) AS shared, least(len(x.tokens), len(y.tokens)) AS least, len(x.tokens) + len(y.tokens) AS total FROM met JOIN mem x ON x.item_id = l JOIN mem y ON y.item_id = r),
edges AS (SELECT l, r FROM pairs WHERE {where})"""


_LINKED = "shared >= 2 AND (shared / CAST(total - shared AS DOUBLE) >= 0.25e0 OR rare >= 2) OR rare > 0 AND least <= 3 AND longest >= 5"
_LEXICAL = "shared / CAST(total - shared AS DOUBLE) >= 0.34e0 OR rare >= 2 OR rare > 0 AND least <= 2 OR least <= 2 AND few > 0"
_REACH = """sym AS (SELECT l AS a, r AS b FROM edges UNION SELECT r, l FROM edges),
reach AS (SELECT item_id AS item, item_id AS root FROM mem UNION SELECT b, root FROM reach JOIN sym ON a = item WHERE root < b)"""
_PROPER = f"""list_filter(list_transform(list_filter(list_transform(regexp_extract_all(title, {_q(L.PROPER_NOUN)}, 1), lambda m: trim(m, ' .''-')),
  lambda m: length(m) >= 2 AND NOT list_contains([{_list(L.ENTITY_BLOCKLIST)}], m) AND NOT list_contains([{_list(sorted(set(L.STOP_WORDS)))}], lower(m))),
  lambda m: regexp_replace(m, '^(?:{"|".join(L.ENTITY_BLOCKLIST)})\\s+', '')), lambda m: NOT regexp_matches(m, '^[A-Z]{{1,4}}s$'))"""
_NAMES = f"""found AS (SELECT draft_id, item_id, unnest({_PROPER}) AS entity, generate_subscripts({_PROPER}, 1) AS pos FROM mem),
counted AS (SELECT draft_id, entity, count(*) AS n, min((item_id, pos)) AS first FROM found GROUP BY 1, 2),
names AS (SELECT draft_id, entity, n, row_number() OVER (PARTITION BY draft_id ORDER BY n DESC, first, entity) AS nth FROM counted QUALIFY nth <= 5),
ents AS (SELECT DISTINCT draft_id, {_KEY.replace('title', 'entity')} AS entity_key FROM names),
mentions AS (SELECT item_id, entity_key FROM mem JOIN (SELECT DISTINCT entity_key FROM ents WHERE length(entity_key) >= 4) ON contains(' ' || text_key || ' ', ' ' || entity_key || ' ')),
together AS (SELECT a.draft_id, a.entity_key AS left_key, b.entity_key AS right_key FROM ents a JOIN ents b ON a.draft_id = b.draft_id AND a.entity_key < b.entity_key
  WHERE (a.entity_key, b.entity_key) IN (SELECT (x.entity_key, y.entity_key) FROM mentions x JOIN mentions y USING (item_id)))"""
_HOLD = """holders AS (SELECT e.draft_id, e.entity_key, m.item_id FROM mentions m JOIN mem USING (item_id) JOIN ents e ON e.draft_id = mem.draft_id AND e.entity_key = m.entity_key)"""
_COHERENT = f"""WITH RECURSIVE {_TOK}, {_pairs('AND a.draft_id = b.draft_id', _LINKED).replace('edges AS', 'links AS')}, {_NAMES}, {_HOLD},
edges AS (SELECT l, r FROM links UNION SELECT a.item_id, b.item_id FROM holders a JOIN holders b USING (draft_id, entity_key) UNION
  SELECT a.item_id, b.item_id FROM together t JOIN holders a ON a.draft_id = t.draft_id AND a.entity_key = t.left_key JOIN holders b ON b.draft_id = t.draft_id AND b.entity_key = t.right_key), {_REACH},
comp AS (SELECT draft_id, item_id, min(root) AS component FROM mem JOIN reach ON item = item_id GROUP BY 1, 2),
sized AS (SELECT *, count(*) OVER (PARTITION BY draft_id, component) AS size, count(*) OVER (PARTITION BY draft_id) AS members FROM comp),
parts AS (SELECT draft_id, count(DISTINCT component) AS parts, count(DISTINCT component) FILTER (size >= 2) AS cores, count(*) FILTER (size = 1) AS alone FROM sized GROUP BY 1),
outcomes AS (SELECT s.*, parts, alone, CASE WHEN parts = 1 THEN 'kept' WHEN size = 1 THEN 'orphan' WHEN cores = 1 THEN 'kept' ELSE 'split' END AS outcome FROM sized s JOIN parts USING (draft_id))"""
_GROUND_TOKENS = f"""{_TOK}, {_NAMES}, {_HOLD}, parts AS (SELECT draft_id, entity_key, unnest(list_filter({_SIG.replace('title', 'entity_key')}, lambda t: length(t) >= 4)) AS token FROM ents),
grounded AS (SELECT draft_id, entity_key FROM holders UNION SELECT draft_id, entity_key FROM parts p GROUP BY 1, 2 HAVING bool_and((draft_id, token) IN (SELECT (draft_id, token) FROM words)))"""
#: A score over 20000 to four digits, halves up as decimals have them (as a binary product 3 / 20000 would round down).
_SHARE = "floor(score / 2 + 0.5e0) / 10000"
_VOTES = "".join(f"len(regexp_extract_all(lower(title), {_q(PATTERNS[c])})) AS v{i}, " for i, c in enumerate(c for c in L.PREFERRED if c in PATTERNS))
_VOTED = [c for c in L.PREFERRED if c in PATTERNS]


def members(s: SparkSession, d: str) -> DataFrame:
    """Titles as members of drafts, DRAFT items in a row each, with the key of their text."""
    df = I.items(s, d).select("item_id", "source", F.col("raw_score").alias("score"), N.normalize_text(F.col("title")).alias("title"), F.floor((F.col("item_id") - 1) / DRAFT).alias("draft_id"))
    return df.withColumn("text_key", X.dedupe_key(F.col("title")))


def entities(m: DataFrame) -> DataFrame:
    return V.draft_entities(m).select("draft_id", X.dedupe_key(F.col("entity")).alias("entity_key")).distinct()


def _coherence(s: SparkSession, d: str) -> DataFrame:
    m = materialize(members(s, d), "titles")
    return K.coherence(materialize(K.draft_components(m, materialize(entities(m), "names")), "components"))


def _together(s: SparkSession, d: str) -> DataFrame:
    m = materialize(members(s, d), "titles")
    e = materialize(entities(m), "names")
    return K.cooccurring(materialize(K.mentions(m, e), "mentions"), e)


def _rehomed(s: SparkSession, d: str) -> DataFrame:
    """Items of sources that only show bare names, as orphans among the drafts of all items."""
    m = materialize(members(s, d), "titles")
    named = materialize(K.grounded(m, materialize(entities(m), "names")), "grounded")
    return K.rehomed(m.where(F.col("source").isin(*L.SOCIAL)), named)


def _voted(s: SparkSession, d: str) -> DataFrame:
    hint = F.when(F.col("item_id") % 3 == 0, F.element_at(F.array(*map(F.lit, L.CATEGORIES)), (F.col("item_id") % 6 + 1).cast("int")))
    return V.category_votes(members(s, d), PATTERNS).withColumn("hint", hint)


def _guarded(s: SparkSession, d: str) -> DataFrame:
    voted = _voted(s, d)
    proposed = voted.select("draft_id").distinct().select("draft_id", F.element_at(F.array(*map(F.lit, L.CATEGORIES)), (F.col("draft_id") % 6 + 1).cast("int")).alias("proposed"))
    return V.guarded_category(proposed, voted)


def _cluster_velocity(s: SparkSession, d: str) -> DataFrame:
    """Runs as clusters of the entities seen in them."""
    v = H.velocity(H.entity_counts(s, d), H.nearest_runs(H.runs(s, d), H.windows(s)))
    ord_ = F.row_number().over(W.partitionBy("run_id").orderBy("entity"))
    return V.cluster_velocity(v.select(F.col("run_id").alias("cluster_id"), F.col("entity").alias("entity_key"), ord_.alias("ord"), "freq", "velocity", (F.col("momentum") == "NEW").alias("is_new")))


def _near_groups(s: SparkSession, d: str) -> DataFrame:
    """Titles of the whole table as one run."""
    keys = I.items(s, d).groupBy(X.dedupe_key(F.col("title")).alias("title_key")).agg(F.min("item_id").alias("first_id"), F.count("*").alias("items"))
    return G.near_groups(keys.withColumn("run_id", F.lit(0))).select("first_id", "title_key", "items", "root_id")


def _questions(s: SparkSession, d: str) -> DataFrame:
    """User turns as questions about the fifteen best-scored titles."""
    top = members(s, d).orderBy(F.desc("score"), "item_id").limit(15)
    trends = top.select(F.row_number().over(W.orderBy(F.desc("score"), "item_id")).alias("rank"), F.col("title").alias("headline"), F.slice(F.split("text_key", " "), 1, 2).alias("entities"))
    asked = table(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))
    return V.question_matches(asked, trends)


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    inferred = f"CASE greatest({', '.join(f'v{i}' for i in range(len(_VOTED)))}) WHEN 0 THEN NULL {' '.join(f'WHEN v{i} THEN {_q(c)}' for i, c in enumerate(_VOTED))} END"
    per = "UNION ALL ".join(f"SELECT draft_id, item_id, {_q(c)} AS category, v{i} AS n FROM votes WHERE v{i} > 0 " for i, c in enumerate(_VOTED))
    technical = "category IN ('Tech', 'Science & AI')"
    return {
        "lexical_components": (lambda s, d: K.lexical_groups(members(s, d)), f"WITH RECURSIVE {_TOK}, {_pairs('AND a.df <= a.join_cap', _LEXICAL)}, {_REACH} SELECT item AS item_id, min(root) AS group_id FROM reach GROUP BY 1"),
        "linked_pairs_in_drafts": (lambda s, d: K.linked(K.shared_tokens(members(s, d), within="draft_id")).select("left_id", "right_id"), f"WITH {_TOK}, {_pairs('AND a.draft_id = b.draft_id', _LINKED)} SELECT l AS left_id, r AS right_id FROM edges"),
        "near_duplicate_groups": (_near_groups, None),
        "draft_names": (lambda s, d: V.draft_entities(members(s, d)), f"WITH {_D}, {_NAMES} SELECT draft_id, entity, n, nth FROM names"),
        "entity_mentions": (lambda s, d: K.mentions(members(s, d), entities(members(s, d))), f"WITH {_D}, {_NAMES} SELECT item_id, entity_key FROM mentions"),
        "entity_cooccurrence": (_together, f"WITH {_D}, {_NAMES} SELECT draft_id, left_key, right_key FROM together"),
        "draft_coherence": (_coherence, f"{_COHERENT} SELECT draft_id, item_id, component, outcome, CASE outcome WHEN 'kept' THEN draft_id WHEN 'split' THEN component END AS home, outcome = 'split' OR outcome = 'kept' AND parts > 1 AND alone * 3 > members AS relabel FROM outcomes"),
        "grounded_entities": (lambda s, d: K.grounded(members(s, d), entities(members(s, d))), f"WITH {_GROUND_TOKENS} SELECT draft_id, entity_key FROM grounded"),
        "orphan_rehome": (
            _rehomed,
            f"WITH {_GROUND_TOKENS} SELECT m.item_id, min(g.draft_id) AS draft_id FROM mem m JOIN grounded g ON length(g.entity_key) >= 4 AND contains(' ' || m.text_key || ' ', ' ' || g.entity_key || ' ') WHERE m.source IN ({_list(L.SOCIAL)}) GROUP BY 1 HAVING count(DISTINCT g.draft_id) = 1",
        ),
        "entity_frequency": (
            lambda s, d: K.entity_frequency(members(s, d).withColumn("duplicate_count", F.col("item_id") % 3 + 1), entities(members(s, d))),
            f"""WITH {_D}, {_NAMES}, forms AS (SELECT DISTINCT entity_key, unnest(CASE WHEN entity_key = '' THEN [] WHEN contains(entity_key, ' ') AND length(split_part(entity_key, ' ', -1)) >= 4 AND split_part(entity_key, ' ', -1) NOT IN ({_list(L.STOP_WORDS + L.GENERIC_ENTITY_TOKENS)})
            THEN [entity_key, split_part(entity_key, ' ', -1)] ELSE [entity_key] END) AS form FROM ents), hit AS (SELECT DISTINCT entity_key, item_id FROM forms JOIN mem ON contains(' ' || text_key || ' ', ' ' || form || ' '))
            SELECT entity_key, CAST(sum(item_id % 3 + 1) AS BIGINT) AS freq FROM hit GROUP BY 1""",
        ),
        "category_votes": (lambda s, d: V.category_votes(members(s, d), PATTERNS).select("item_id", "inferred", F.element_at("votes", "Sports").alias("sports")), f"WITH {_D}, votes AS (SELECT {_VOTES} item_id FROM mem) SELECT item_id, {inferred} AS inferred, CAST(v0 AS INT) AS sports FROM votes"),
        "guarded_category": (
            _guarded,
            f"""WITH {_D}, votes AS (SELECT {_VOTES} item_id, draft_id FROM mem), cast_votes AS ({per}), tally AS (SELECT draft_id, category, CAST(sum(n) AS BIGINT) AS votes, min(item_id) AS first FROM cast_votes GROUP BY 1, 2),
            hints AS (SELECT draft_id, category, count(*) AS n, min(item_id) AS first FROM (SELECT draft_id, item_id, ([{_list(L.CATEGORIES)}])[item_id % 6 + 1] AS category FROM mem WHERE item_id % 3 = 0) GROUP BY 1, 2),
            v AS (SELECT draft_id, coalesce(sum(votes) FILTER ({technical}), 0) AS tech_votes, max(votes) FILTER (NOT {technical}) AS other_votes, max_by(category, (votes, -first, category)) FILTER (NOT {technical}) AS other,
              max(votes) AS top_votes, max_by(category, (votes, -first, category)) AS top, coalesce(sum(votes) FILTER (category = 'Sports'), 0) AS sport_votes FROM tally GROUP BY 1),
            h AS (SELECT draft_id, coalesce(sum(n) FILTER ({technical}), 0) AS tech_hints, max_by(category, (n, -first, category)) FILTER (NOT {technical}) AS other_hint, count(*) FILTER (category = 'Sports') AS sport_hints FROM hints GROUP BY 1),
            p AS (SELECT draft_id, ([{_list(L.CATEGORIES)}])[draft_id % 6 + 1] AS proposed, bool_and(source IN ('arxiv', 'ai_papers')) AS papers FROM mem GROUP BY 1, 2)
            SELECT draft_id, CASE WHEN papers THEN 'Science & AI' WHEN proposed IN ('Tech', 'Science & AI') AND coalesce(tech_hints, 0) = 0 AND (coalesce(tech_votes, 0) = 0 OR coalesce(other_votes, 0) >= 2 * tech_votes) THEN coalesce(other, other_hint, 'News')
              WHEN proposed = 'Sports' AND coalesce(sport_votes, 0) = 0 AND coalesce(sport_hints, 0) = 0 AND coalesce(top_votes, 0) >= 2 THEN top ELSE proposed END AS category FROM p LEFT JOIN v USING (draft_id) LEFT JOIN h USING (draft_id)""",
        ),
        "draft_category": (
            lambda s, d: V.draft_category(_voted(s, d), F.struct(-F.col("score"), F.col("item_id"))),
            f"""WITH {_D}, votes AS (SELECT {_VOTES} item_id, draft_id FROM mem), cast_votes AS (SELECT draft_id, item_id, category, CAST(n AS BIGINT) AS n, list_position([{_list(_VOTED)}], category) AS pos FROM ({per})
              UNION ALL SELECT draft_id, item_id, ([{_list(L.CATEGORIES)}])[item_id % 6 + 1], 2, 99 FROM mem WHERE item_id % 3 = 0),
            tally AS (SELECT draft_id, category, sum(n) AS n, min((-score, item_id, pos)) AS met FROM cast_votes JOIN (SELECT item_id, score FROM mem) USING (item_id) GROUP BY 1, 2),
            best AS (SELECT draft_id, arg_min(category, (-n, met)) AS category FROM tally GROUP BY 1)
            SELECT draft_id, coalesce(category, 'News') AS category FROM (SELECT DISTINCT draft_id FROM mem) LEFT JOIN best USING (draft_id)""",
        ),
        "best_member_title": (
            lambda s, d: V.best_title(members(s, d).withColumn("score", F.round(F.col("score") / 20000, 4))).select("draft_id", F.lower("title").alias("title")),
            f"""WITH {_D}, top AS (SELECT draft_id, title, {_SHARE} AS score, len(tokens) AS n, row_number() OVER (PARTITION BY draft_id ORDER BY {_SHARE} DESC, item_id) AS nth FROM mem QUALIFY nth <= 6)
            SELECT draft_id, lower(max_by(title, (round(score + 0.04e0 * least(n, 8) - CASE WHEN n < 2 THEN 0.3e0 ELSE 0e0 END, 9), -nth))) AS title FROM top GROUP BY 1""",
        ),
        "cluster_velocity": (
            _cluster_velocity,
            f"""WITH {_NEAR}, {_COUNTS}, rated AS (SELECT run_id, entity, freq, total, 100e0 * freq / greatest(1, total) AS rate FROM counts JOIN totals USING (run_id)),
            m AS (SELECT n.run_id, n.entity, n.freq, weight, n.rate, coalesce(b.rate, 0e0) AS base, t.total AS ref_total FROM rated n JOIN near ON n.run_id = now_id JOIN totals t ON t.run_id = ref_id LEFT JOIN rated b ON b.run_id = ref_id AND b.entity = n.entity),
            v AS (SELECT run_id, entity, freq, round(50 + 50 * sum(weight * tanh((rate - base) / greatest(base, 100e0 / ref_total) / 2)) / sum(weight), 3) AS velocity, max(base) AS most FROM m GROUP BY 1, 2, 3),
            o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY entity) AS ord, CASE WHEN most = 0 AND freq > 0 THEN 'NEW'{_MOMENTUM} ELSE 'FADING' END AS momentum FROM v)
            SELECT run_id AS cluster_id, round(sum(freq * velocity) / sum(freq), 6) AS velocity, max_by(entity, (freq, -ord)) AS shown, bool_and(momentum = 'NEW') AS is_new FROM o GROUP BY 1""",
        ),
        "question_trend_match": (
            _questions,
            f"""WITH {_D}, trends AS (SELECT row_number() OVER (ORDER BY score DESC, item_id) AS rank, tokens, string_split(text_key, ' ')[1:2] AS entities FROM mem QUALIFY rank <= 15),
            q AS (SELECT conv_id * 1000 + turn AS question_id, lower(coalesce(text, '')) AS title FROM conversations WHERE role = 'user'),
            r AS (SELECT question_id, title, list_filter(list_transform(regexp_extract_all(title, {_q(L.TREND_REF)}, 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND n) AS refs FROM q CROSS JOIN (SELECT count(*) AS n FROM trends)),
            direct AS (SELECT question_id, rank, min(pos) AS pos FROM (SELECT question_id, unnest(refs) AS rank, generate_subscripts(refs, 1) AS pos FROM r) GROUP BY 1, 2),
            met AS (SELECT question_id, rank, len(list_intersect({_SIG}, tokens)) AS overlap, len(list_filter(entities, lambda e: length(e) >= 3 AND contains(title, e))) > 0 AS named FROM r CROSS JOIN trends WHERE len(refs) = 0),
            ranked AS (SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS nth FROM direct UNION ALL
              SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY overlap + CASE WHEN named THEN 2 ELSE 0 END DESC, rank DESC) FROM met WHERE overlap >= 2 OR named)
            SELECT question_id, CAST(rank AS INT) AS rank, CAST(nth AS INT) AS nth FROM ranked WHERE nth <= 2""",
        ),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items() if sql}
