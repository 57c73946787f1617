"""Queries over titles and drafts of clusters, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.functions import normalize as N
from trendspark.functions import plain
from trendspark.functions import text as X
from trendspark.operators import drafts as D
from trendspark.operators import history as H
from trendspark.operators import items as I
from trendspark.operators import titles as T
from trendspark.plans.catalogue import _GROUPS, _ITEMS, _SIG, REASON, _list
from trendspark.session import table
from trendspark.streaming.loop import closed_hours


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _normal(text: str) -> str:
    out = f"coalesce({text}, '')"
    for sign, plain in N.SIGNS:
        out = f"replace({out}, {_q(sign)}, {_q(plain)})"
    out = f"translate({out}, {_q(N.LATIN)}, {_q(N.PLAIN)})"
    for pattern, plain in N.CLEAN:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(plain)}, 'g')"
    return f"trim({out}, {_q(N.EDGES)})"


#: Texts with entities and compatible characters, and what they say in plain ASCII.
ENTITLED = [("&eacute;t&eacute;", "ete"), ("Tom&#8217;s", "Tom's"), ("\ufb01re \ufb02ood", "fire flood"), ("\uff26\uff35\uff2c\uff2c width", "FULL width"), ("1&frac12; cups", "112 cups"), ("&#x1F600; grin", "grin"), ("R&D &copy", "R&D"), ("\u2168 \u210c", "IX H")]


def _entitled(items: DataFrame) -> DataFrame:
    shown = F.element_at(F.array(*[F.lit(t) for t, _ in ENTITLED]), (F.col("item_id") % len(ENTITLED) + 1).cast("int"))
    return items.withColumn("title", F.concat_ws(" ", shown, "title"))


def _alias_case() -> str:
    alias = {a: c for c, names in L.CATEGORY_ALIASES.items() for a in names}
    exact = "".join(f" WHEN key = {_q(a)} THEN {_q(c)}" for a, c in (alias | {c.lower(): c for c in L.CATEGORIES}).items())
    held = "".join(f" WHEN contains(key, {_q(a)}) THEN {_q(c)}" for a, c in alias.items())
    return f"CASE WHEN coalesce(title, '') = '' THEN 'News'{exact}{held} ELSE 'News' END"


_CLEAN = f"{_ITEMS}, clean AS (SELECT item_id, source, title, {_normal('title')} AS clean_title FROM items)"
_PICK = lambda names, i: f"([{_list(names)}])[{i} + 1]"
_MEMBERS = f"""members AS (SELECT l_orderkey AS draft_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS item_id, l_discount * 10 AS score, {_PICK(L.SOURCES, f'l_suppkey % {len(L.SOURCES)}')} AS source,
  CAST(l_linenumber AS BIGINT) AS duplicate_count, 'https://example.org/' || (l_partkey % 50) AS url, CASE WHEN l_partkey % 7 <> 0 THEN {_PICK(L.CATEGORIES, f'l_partkey % {len(L.CATEGORIES)}')} END AS hint, l_quantity AS quantity FROM lineitem)"""
_ROLLUP = f"""{_MEMBERS}, firsts AS (SELECT draft_id, url, min(item_id) AS first FROM members GROUP BY 1, 2), nths AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY first, url) AS nth FROM firsts),
urls AS (SELECT draft_id, list(url ORDER BY nth) AS urls FROM nths WHERE nth <= {D.URLS} GROUP BY 1),
rollup AS (SELECT * FROM (SELECT draft_id, count(*) AS members, CAST(sum(greatest(1, duplicate_count)) AS BIGINT) AS raw_items, avg(score) AS mean_score, max(score) AS best_score, list_sort(list(DISTINCT source)) AS sources,
  CAST(round_even(max(quantity) % 10 + 1, 0) AS INT) AS llm_relevance FROM members GROUP BY 1) LEFT JOIN urls USING (draft_id))"""
_DRAFTS = f"""{_ROLLUP}, parts AS (SELECT *, least(1e0, len(sources) / 3e0) AS spread, 1 + 9 * (0.40e0 * mean_score + 0.35e0 * least(1e0, len(sources) / 3e0) + 0.25e0 * least(1e0, log2(1e0 + raw_items) / log2(9e0))) AS h FROM rollup),
rated AS (SELECT *, round(h, 6) AS heuristic_relevance, CAST(greatest(1, least(10, round_even(round(0.65e0 * llm_relevance + 0.35e0 * h, 6), 0))) AS INT) AS relevance,
  round(greatest(0e0, least(100e0, round(50 + 30 * (2 * mean_score - 1) + 10 * spread, 6))), 1) AS velocity FROM parts),
scored AS (SELECT *, round(0.6e0 * relevance * 10 + 0.4e0 * velocity, 2) AS combined FROM rated)"""
_MODE = """hints AS (SELECT draft_id, coalesce(hint, 'News') AS category, count(*) AS n, min(item_id) AS first FROM members GROUP BY 1, 2),
modes AS (SELECT draft_id, category FROM hints QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY n DESC, first) = 1)"""


def _drafts(s: SparkSession, d: str) -> DataFrame:
    return D.scored(D.rollup(D.members(s, d)))


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Drafts of one customer are one cluster."""
    m = D.members(s, d)
    owner = table(s, d, "orders").select(F.col("o_orderkey").alias("draft_id"), F.col("o_custkey").alias("cluster_id"))
    return D.merge_clusters(D.scored(D.rollup(m)).join(D.category_mode(m), "draft_id").join(owner, "draft_id"), "cluster_id")


def _claims(s: SparkSession, d: str) -> DataFrame:
    """Parts as items: returned lines discard them, accepted ones cluster them, in this order."""
    claims = table(s, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 25)).select(F.col("l_partkey").alias("item_id"), F.when(F.col("l_returnflag") == "R", "discarded").otherwise("clustered").alias("claim"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("priority"))
    return D.one_claim(claims, table(s, d, "part").select(F.col("p_partkey").alias("item_id")))


def _discard_weights(s: SparkSession, d: str) -> DataFrame:
    """Raw items by reason: discarded items with the weight of their exact group, 1 where they stand for no group."""
    items = I.items(s, d)
    gone = I.discard_reason(items).where("discard_reason IS NOT NULL").select("item_id", "discard_reason")
    weight = I.exact_groups(items).select("item_id", "duplicate_count")
    return gone.join(weight, "item_id", "left").groupBy("discard_reason").agg(F.count("*").alias("items"), F.sum(F.coalesce("duplicate_count", F.lit(1))).cast("long").alias("raw_items"))


def _display(s: SparkSession, d: str) -> DataFrame:
    return D.rollup(D.members(s, d)).select("draft_id", N.display_sources(F.col("sources")).alias("shown"), F.array_join("urls", " ").alias("urls"))


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    reasons = f"""CASE WHEN source IN ('tiktok', 'x_trends24') AND (list_contains([{_list(L.GENERIC_HASHTAGS)}], lower(regexp_replace(clean_title, '[# ]', '', 'g'))) OR regexp_matches(lower(regexp_replace(clean_title, '[# ]', '', 'g')), {_q(f'^(?:{L.GENERIC_HASHTAG})$')})) THEN 'generic_hashtag'
      WHEN source IN ({_list(L.ANECDOTE_SOURCES)}) AND regexp_matches(clean_title, {_q('(?i)' + L.ANECDOTE)}) THEN 'personal_anecdote' WHEN source IN ({_list(L.SOCIAL)}) AND regexp_matches(clean_title, {_q('(?i)' + L.MEME_PHOTO)}) THEN 'meme_or_photo'
      WHEN source IN ({_list(L.SOCIAL)}) AND regexp_matches(clean_title, {_q('(?i)' + L.PET)}) THEN 'pet_post' WHEN source NOT IN ({_list(L.NO_BOX_SCORE_SOURCES)}) AND regexp_matches(clean_title, {_q('(?i)' + L.BOX_SCORE)}) THEN 'box_score_or_betting' END"""
    generic = _SIG.replace("lower(title)", f"lower(regexp_replace(coalesce(title, ''), {_q('(?i)' + L.CATEGORY_PREFIX)}, ''))")
    headline = lambda s, d: I.items(s, d).select("item_id", F.substring_index("title", " ", 3).alias("title"))
    head = f"{_ITEMS}, heads AS (SELECT item_id, array_to_string(string_split(title, ' ')[1:3], ' ') AS title FROM items)"
    return {
        "normalized_title": (lambda s, d: I.items(s, d).select("item_id", N.normalize_text(F.col("title")).alias("clean_title")), f"WITH {_CLEAN} SELECT item_id, clean_title FROM clean"),
        "unescaped_title": (
            lambda s, d: _entitled(I.items(s, d)).select("item_id", plain.normalized(F.col("title")).alias("clean_title")),
            f"WITH {_ITEMS}, v AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_q(p)})' for i, (_, p) in enumerate(ENTITLED))}) v(nth, plain)), t AS (SELECT item_id, plain || ' ' || title AS title FROM items JOIN v ON nth = item_id % {len(ENTITLED)}) SELECT item_id, {_normal('title')} AS clean_title FROM t",
        ),
        "title_reason": (lambda s, d: T.title_reason(I.items(s, d)).select("item_id", "title_reason"), f"WITH {_CLEAN} SELECT item_id, {reasons} AS title_reason FROM clean"),
        "coerced_category": (lambda s, d: headline(s, d).select("item_id", N.coerce_category(F.col("title")).alias("category")), f"WITH {head}, keyed AS (SELECT item_id, title, lower({_normal('title')}) AS key FROM heads) SELECT item_id, {_alias_case()} AS category FROM keyed"),
        "generic_headline": (
            lambda s, d: headline(s, d).select("item_id", N.is_generic_headline(F.col("title")).alias("generic")),
            f"WITH {head} SELECT item_id, len(list_filter({generic}, lambda t: NOT list_contains([{_list(sorted(set(L.GENERIC_HEADLINE_WORDS)))}], t))) = 0 AS generic FROM heads",
        ),
        "safe_name": (lambda s, d: table(s, d, "pages").select("page_id", N.safe_name(F.col("url")).alias("name")), "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'issue') AS name FROM pages"),
        "score_bar": (lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", N.bar(F.col("l_discount") * 10).alias("bar")), "SELECT l_orderkey, l_linenumber, rpad(repeat('#', CAST(round_even(greatest(0e0, least(1e0, l_discount * 10)) * 10, 0) AS INT)), 10, '.') AS bar FROM lineitem"),
        "unit_vectors": (
            lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.element_at(N.unit_vector(F.col("embedding")), 1), 6).alias("first"), F.round(X.dot(N.unit_vector(F.col("embedding")), N.unit_vector(F.col("embedding"))), 6).alias("norm")),
            "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / CASE n WHEN 0 THEN 1 ELSE n END, 6) AS first, round(CASE n WHEN 0 THEN 0e0 ELSE 1e0 END, 6) AS norm FROM (SELECT *, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)",
        ),
        "cluster_rollup": (_display, f"WITH {_ROLLUP}, named AS (SELECT draft_id, urls, list_transform(sources, lambda s: MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in L.SOURCE_DISPLAY.items())}}}[s]) AS sources FROM rollup) SELECT draft_id, CASE len(sources) WHEN 1 THEN sources[1] ELSE array_to_string(sources[1:-2], ', ') || ' and ' || sources[-1] END AS shown, array_to_string(urls, ' ') AS urls FROM named"),
        "heuristic_relevance": (lambda s, d: _drafts(s, d).select("draft_id", "members", "raw_items", "heuristic_relevance"), f"WITH {_DRAFTS} SELECT draft_id, members, raw_items, heuristic_relevance FROM scored"),
        "cold_start_scores": (lambda s, d: _drafts(s, d).select("draft_id", "relevance", "velocity", "combined"), f"WITH {_DRAFTS} SELECT draft_id, relevance, velocity, combined FROM scored"),
        "draft_drop_reason": (
            lambda s, d: D.drop_reason(D.rollup(D.members(s, d))).select("draft_id", "drop_reason"),
            f"WITH {_ROLLUP} SELECT draft_id, CASE WHEN llm_relevance < {D.LEAST_RELEVANCE} THEN 'low_relevance' WHEN members < 2 AND len(sources) < 2 AND raw_items < 2 AND best_score < 0.80e0 AND llm_relevance < 7 THEN 'weak_singleton' END AS drop_reason FROM rollup",
        ),
        "report_top": (lambda s, d: D.report(_drafts(s, d)).select("rank", "draft_id", "combined"), f"WITH {_DRAFTS} SELECT row_number() OVER (ORDER BY combined DESC, relevance DESC, raw_items DESC, draft_id) AS rank, draft_id, combined FROM scored QUALIFY rank <= 15"),
        "category_mode": (lambda s, d: D.category_mode(D.members(s, d)), f"WITH {_MEMBERS}, {_MODE} SELECT draft_id, category FROM modes"),
        "category_mix": (lambda s, d: D.category_mode(D.members(s, d)).groupBy("category").agg(F.count("*").alias("clusters")), f"WITH {_MEMBERS}, {_MODE} SELECT category, count(*) AS clusters FROM modes GROUP BY 1"),
        "merged_clusters": (
            _merged,
            f"""WITH {_DRAFTS}, {_MODE} SELECT o_custkey AS cluster_id, min(draft_id) AS draft_id, CAST(sum(members) AS BIGINT) AS members, CAST(sum(raw_items) AS BIGINT) AS raw_items, max(relevance) AS relevance, min_by(category, draft_id) AS category
            FROM scored JOIN modes USING (draft_id) JOIN orders ON o_orderkey = draft_id GROUP BY 1""",
        ),
        "partition_claims": (
            _claims,
            """SELECT p_partkey AS item_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'discarded' WHEN bool_or(l_returnflag = 'A') THEN 'clustered' ELSE 'unsupported_grouping' END AS claim
            FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 25 AND l_returnflag IN ('A', 'R')) ON l_partkey = p_partkey GROUP BY 1""",
        ),
        "discard_weights": (
            _discard_weights,
            f"WITH {_GROUPS}, gone AS (SELECT item_id, {REASON} AS discard_reason FROM items) SELECT discard_reason, count(*) AS items, CAST(sum(coalesce(duplicate_count, 1)) AS BIGINT) AS raw_items FROM gone LEFT JOIN grouped USING (item_id) WHERE discard_reason IS NOT NULL GROUP BY 1",
        ),
        "stream_closed_hours": (
            closed_hours,
            "SELECT CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS run_id, event_type AS entity, count(*) AS freq FROM events GROUP BY 1, 2 HAVING (run_id + 3600) * 1000 <= (SELECT floor(max(epoch_us(ts)) / 1000) FROM events)",
        ),
        "run_count": (lambda s, d: H.runs(s, d).agg(F.count_if("finished").alias("runs")), "SELECT count(DISTINCT floor(epoch_us(ts) / 3600000000)) - 1 AS runs FROM events"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items() if sql}
