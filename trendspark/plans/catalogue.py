"""The engine's own queries by name, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions import text as X
from trendspark.functions.lexicon import DEFAULT_WEIGHT, MOMENTUM, SOCIAL, SOURCE_WEIGHTS, SOURCES, STAGE_OF_REASON, STOP_WORDS, TOKEN, WINDOWS
from trendspark.operators import history as H
from trendspark.operators import items as I
from trendspark.session import materialize, table

FLAGSHIP = "select_budgeted_topk"


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TOKEN = TOKEN.replace("'", "''")
_ITEMS = f"""items AS (
  SELECT doc_id + 1 AS item_id, substr(split_part(text, chr(10), 1), 1, 350) AS title,
         ([{_list(SOURCES)}])[CAST(substr(source, 4) AS INT) % {len(SOURCES)} + 1] AS source,
         CAST(n_chars AS DOUBLE) AS raw_score, n_chars % 97 AS comment_count FROM documents)"""
_KEY = "regexp_replace(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), '^the ', '')"
_SIG = f"list_distinct(list_filter(regexp_extract_all(lower(title), '{_TOKEN}'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains([{_list(sorted(set(STOP_WORDS)))}], t)))"
REASON = f"""CASE WHEN source = 'reddit' AND (raw_score < 20 OR comment_count < 5) THEN 'reddit_low_engagement' WHEN source = 'hackernews' AND raw_score < 10 THEN 'hn_low_points'
  WHEN source = 'github' AND raw_score < 20 THEN 'github_low_stars' WHEN length(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) < 2 OR regexp_matches(regexp_replace(title, '[^A-Za-z0-9]', '', 'g'), '^[0-9]+$') THEN 'too_short_or_non_ascii'
  WHEN source IN ({_list(SOCIAL)}) AND len({_SIG}) = 0 AND NOT regexp_matches(title, '[A-Z]') THEN 'no_signal_tokens' END"""
_GROUPS = f"""{_ITEMS}, keyed AS (SELECT *, {_KEY} AS title_key FROM items),
best AS (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY raw_score DESC, item_id) AS nth,
         count(*) OVER (PARTITION BY title_key) AS duplicate_count, min(item_id) OVER (PARTITION BY title_key) AS first_id FROM keyed),
grouped AS (SELECT title_key, item_id, title, source, raw_score, comment_count, duplicate_count, first_id FROM best WHERE nth = 1)"""
_PCT = f"""{_GROUPS}, pct AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY source) <= 1 THEN 0.75e0 ELSE
  (rank() OVER (PARTITION BY source ORDER BY raw_score) - 1 + 0.5e0 * count(*) OVER (PARTITION BY source, raw_score)) / count(*) OVER (PARTITION BY source) END AS pct FROM grouped)"""
_SCORED = f"""{_PCT}, words AS (SELECT item_id, source, unnest({_SIG}) AS token FROM pct),
rare AS (SELECT token FROM words GROUP BY token HAVING count(*) <= (SELECT greatest(3, floor(0.08e0 * count(*))) FROM pct)),
others AS (SELECT a.item_id, count(DISTINCT b.source) AS others FROM words a JOIN rare USING (token) JOIN words b ON a.token = b.token AND a.source <> b.source GROUP BY a.item_id),
weights AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in SOURCE_WEIGHTS.items())}) t(source, w)),
scored AS (SELECT pct.*, coalesce(others, 0) AS others, round(greatest(0e0, least(1e0, 0.20e0 + 0.45e0 * pct * coalesce(w, {DEFAULT_WEIGHT}e0) + 0.10e0 * least(3, coalesce(others, 0))
  + least(0.15e0, 0.05e0 * (duplicate_count - 1)) + CASE WHEN comment_count > 0 THEN least(0.10e0, log10(1 + comment_count) / 30) ELSE 0e0 END)), 4) AS score
  FROM pct LEFT JOIN others USING (item_id) LEFT JOIN weights USING (source))"""
_PICKED = f"""{_SCORED}, placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, item_id) <= {I.FLOOR} AS in_floor FROM scored),
picked AS (SELECT * FROM placed ORDER BY in_floor DESC, score DESC, item_id LIMIT {I.BUDGET})"""
_HOUR = "CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT)"
_RUNS = f"""kept AS (SELECT {_HOUR} AS run_id, count(*) FILTER (event_type <> 'click') AS kept FROM events GROUP BY 1),
runs AS (SELECT run_id, CAST(run_id AS DOUBLE) AS started_at, kept, run_id < (SELECT max(run_id) FROM kept) AS finished FROM kept)"""
_NEAR = f"""{_RUNS}, windows AS (SELECT * FROM (VALUES {", ".join(f"({h}e0, {w}e0)" for h, w in WINDOWS)}) t(hours, weight)),
met AS (SELECT r.run_id AS now_id, hours, weight, p.run_id AS ref_id, p.kept AS ref_kept,
  row_number() OVER (PARTITION BY r.run_id, hours ORDER BY abs(p.started_at - (r.started_at - hours * 3600)), p.started_at) AS nth
  FROM runs r CROSS JOIN windows JOIN runs p ON p.finished AND p.run_id <> r.run_id AND p.started_at BETWEEN r.started_at - 1.5e0 * hours * 3600 AND r.started_at - 0.5e0 * hours * 3600),
near AS (SELECT now_id, hours, weight, ref_id, ref_kept FROM met WHERE nth = 1 AND ref_kept > 0)"""
_COUNTS = f"counts AS (SELECT {_HOUR} AS run_id, event_type AS entity, count(*) AS freq FROM events GROUP BY 1, 2), totals AS (SELECT run_id, sum(freq) AS total FROM counts GROUP BY 1)"
_MOMENTUM = "".join(f" WHEN velocity {'>' if n == 'STEADY' else '>='} {b} THEN '{n}'" for b, n in MOMENTUM)


def _near(spark: SparkSession, d: str) -> DataFrame:
    return H.nearest_runs(H.runs(spark, d), H.windows(spark))


def _kept_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each raw item and whether it stands for its content hash: the first with the hash, if a group's best item has it."""
    raw = I.items(spark, d).withColumn("hash", X.content_hash(F.col("source"), F.col("title"), F.lit(None).cast("string")))
    kept = I.exact_groups(I.items(spark, d)).select(X.content_hash(F.col("source"), F.col("title"), F.lit(None).cast("string")).alias("hash")).distinct()
    first = raw.groupBy("hash").agg(F.min("item_id").alias("item_id")).join(kept, "hash", "left_semi").select("item_id", F.lit(True).alias("kept"))
    return raw.join(first, "item_id", "left").select("item_id", F.col("hash").alias("content_hash"), F.coalesce("kept", F.lit(False)).alias("kept"))


def _over_budget(spark: SparkSession, d: str) -> DataFrame:
    df = materialize(I.scored(I.items(spark, d)), "scored")
    left = df.join(I.select_budget(df).select("item_id"), "item_id", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("items"), F.sum(F.greatest(F.lit(1), F.col("duplicate_count"))).alias("raw_items"))


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    sig = lambda: X.significant_tokens(F.col("title"))
    return {
        "source_cap": (lambda s, d: I.source_cap(I.items(s, d)).select("item_id", "source", "position"), f"WITH {_ITEMS} SELECT item_id, source, row_number() OVER (PARTITION BY source ORDER BY item_id) AS position FROM items QUALIFY position <= {I.SOURCE_CAP}"),
        "discard_reason_counts": (
            lambda s, d: I.discard_reason(I.items(s, d)).groupBy("source", "discard_reason").agg(F.count("*").alias("n")),
            f"WITH {_ITEMS} SELECT source, {REASON} AS discard_reason, count(*) AS n FROM items GROUP BY ALL",
        ),
        "dedupe_exact_representative": (
            lambda s, d: I.exact_groups(I.items(s, d)).select("title_key", "item_id", "raw_score", "duplicate_count", "first_id", "sources"),
            f"WITH {_GROUPS}, s AS (SELECT title_key, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM keyed GROUP BY 1) SELECT title_key, item_id, raw_score, duplicate_count, first_id, sources FROM grouped JOIN s USING (title_key)",
        ),
        "percentile_midrank": (lambda s, d: I.percentile(I.exact_groups(I.items(s, d))).select("item_id", "source", F.round("pct", 6).alias("pct")), f"WITH {_PCT} SELECT item_id, source, round(pct, 6) AS pct FROM pct"),
        "significant_token_df": (lambda s, d: I.items(s, d).select(F.explode(sig()).alias("token")).groupBy("token").agg(F.count("*").alias("df")), f"WITH {_ITEMS}, words AS (SELECT unnest({_SIG}) AS token FROM items) SELECT token, count(*) AS df FROM words GROUP BY token"),
        "heuristic_score": (lambda s, d: I.scored(I.items(s, d)).select("item_id", F.coalesce("others", F.lit(0)).cast("long").alias("others"), "score"), f"WITH {_SCORED} SELECT item_id, others, score FROM scored"),
        FLAGSHIP: (lambda s, d: I.select_budget(I.scored(I.items(s, d))).select("rank", "item_id", "source", "score", "in_floor"), f"WITH {_PICKED} SELECT row_number() OVER (ORDER BY score DESC, item_id) AS rank, item_id, source, score, in_floor FROM picked"),
        "over_budget": (_over_budget, f"WITH {_PICKED} SELECT source, count(*) AS items, CAST(sum(duplicate_count) AS BIGINT) AS raw_items FROM scored WHERE item_id NOT IN (SELECT item_id FROM picked) GROUP BY source"),
        "token_link_pairs": (
            lambda s, d: I.link_pairs(I.exact_groups(I.items(s, d)).select("item_id", sig().alias("tokens"))),
            f"""WITH {_GROUPS}, t AS (SELECT item_id, {_SIG} AS tokens FROM grouped), words AS (SELECT item_id, unnest(tokens) AS token, len(tokens) AS size FROM t),
            rare AS (SELECT token FROM words GROUP BY 1 HAVING count(*) <= (SELECT greatest(12, floor(0.10e0 * count(*))) FROM grouped)), kept AS (SELECT * FROM words JOIN rare USING (token))
            SELECT a.item_id AS left_id, b.item_id AS right_id, count(*) AS shared, round(count(*) / CAST(any_value(a.size) + any_value(b.size) - count(*) AS DOUBLE), 6) AS jaccard
            FROM kept a JOIN kept b ON a.token = b.token AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) / CAST(any_value(a.size) + any_value(b.size) - count(*) AS DOUBLE) >= 0.25""",
        ),
        "title_excerpt": (
            lambda s, d: I.items(s, d).select("item_id", X.excerpt(F.col("title"), 30).alias("excerpt")),
            f"""WITH {_ITEMS} SELECT item_id, CASE WHEN length(title) <= 30 THEN title ELSE regexp_replace(CASE WHEN contains(substr(title, 1, 30), ' ') THEN regexp_replace(substr(title, 1, 30), ' [^ ]*$', '') ELSE substr(title, 1, 30) END, '[ ,;:-]+$', '') || '...' END AS excerpt FROM items""",
        ),
        "kept_flag_join": (
            _kept_flags,
            f"""WITH {_GROUPS}, hashed AS (SELECT item_id, sha1(concat_ws('|', source, lower(trim(title)), '')) AS content_hash FROM items), kept AS (SELECT DISTINCT sha1(concat_ws('|', source, lower(trim(title)), '')) AS content_hash FROM grouped)
            SELECT item_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY item_id) = 1 AND content_hash IN (SELECT content_hash FROM kept) AS kept FROM hashed""",
        ),
        "cluster_id_hash": (
            lambda s, d: I.items(s, d).select("item_id", X.cluster_id(sig(), F.col("title")).alias("cluster_id")),
            f"WITH {_ITEMS} SELECT item_id, substr(sha1(CASE WHEN len({_SIG}) > 0 THEN array_to_string(list_sort({_SIG}), '|') ELSE lower(trim(title)) END), 1, 12) AS cluster_id FROM items",
        ),
        "nearest_reference_run": (_near, f"WITH {_NEAR} SELECT now_id, hours, weight, ref_id, ref_kept FROM near"),
        "entity_velocity": (
            lambda s, d: H.velocity(H.entity_counts(s, d), _near(s, d)),
            f"""WITH {_NEAR}, {_COUNTS}, rated AS (SELECT run_id, entity, freq, total, 100e0 * freq / greatest(1, total) AS rate FROM counts JOIN totals USING (run_id)),
            m AS (SELECT n.run_id, n.entity, n.freq, weight, n.rate, coalesce(b.rate, 0e0) AS base, t.total AS ref_total FROM rated n JOIN near ON n.run_id = now_id JOIN totals t ON t.run_id = ref_id LEFT JOIN rated b ON b.run_id = ref_id AND b.entity = n.entity),
            v AS (SELECT run_id, entity, freq, round(50 + 50 * sum(weight * tanh((rate - base) / greatest(base, 100e0 / ref_total) / 2)) / sum(weight), 3) AS velocity, max(base) AS most FROM m GROUP BY 1, 2, 3)
            SELECT run_id, entity, freq, velocity, CASE WHEN most = 0 AND freq > 0 THEN 'NEW'{_MOMENTUM} ELSE 'FADING' END AS momentum FROM v""",
        ),
        "entity_snapshot_upsert": (
            lambda s, d: H.snapshots(H.entity_counts(s, d)),
            f"WITH {_COUNTS} SELECT CAST(floor(run_id / 86400) AS BIGINT) AS day, entity, max(freq) AS freq, max(round(100e0 * freq / total, 4)) AS rate FROM counts JOIN totals USING (run_id) GROUP BY 1, 2",
        ),
        "latest_runs": (lambda s, d: H.latest_runs(H.runs(s, d)), f"WITH {_RUNS} SELECT run_id, started_at, kept, finished, row_number() OVER (ORDER BY started_at DESC) AS nth FROM runs WHERE finished QUALIFY nth <= 6"),
        "retention_purge": (lambda s, d: H.retained(H.runs(s, d)), f"WITH {_RUNS} SELECT * FROM runs WHERE started_at >= (SELECT max(started_at) FROM runs) - 7 * 86400"),
        "ledger_by_stage": (H.ledger, f"SELECT l_returnflag AS reason, count(*) AS raw_items, CASE l_returnflag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF_REASON.items())} END AS stage FROM lineitem GROUP BY 1"),
        "ledger_balance": (
            H.ledger_balance,
            "SELECT l_orderkey AS run_id, count(*) AS ingested, count(*) FILTER (l_returnflag = 'R') AS discarded, count(*) FILTER (l_returnflag <> 'R') AS clustered, count(*) - count(*) FILTER (l_returnflag = 'R') - count(*) FILTER (l_returnflag <> 'R') AS unaccounted FROM lineitem GROUP BY 1",
        ),
        "cosine_gate_onepass": (
            H.cosine_gate,
            """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
            SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), c) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(c, c))), 6) AS similarity FROM embeddings JOIN c USING (label) WHERE similarity >= 0""",
        ),
        "page_title_meta": (H.page_titles, "SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages"),
        "chat_history_tail": (
            H.history_tail,
            "SELECT conv_id, turn, role, substr(text, 1, 4000) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' QUALIFY back <= 5",
        ),
        "nation_dimension": (
            lambda s, d: table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("unknown")).alias("region")),
            "SELECT n_name, coalesce(r_name, 'unknown') AS region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
        ),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items() if sql}
