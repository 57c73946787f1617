"""Queries over pages, with the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.operators import pages as G
from trendspark.plans.clusters import _normal, _q
from trendspark.session import table


def _meta(name: str) -> str:
    tag = f"regexp_extract(html, {_q(rf'(?is)(<meta\s[^>]*(?:property|name)\s*=\s*[\"\']{name}[\"\'][^>]*>)')}, 1)"
    return f"nullif(regexp_extract({tag}, {_q(r'(?is)\scontent\s*=\s*\"([^\"]*)\"')}, 1), '')"


def _bare(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in G.NO_PROSE:
        out = f"regexp_replace({out}, {_q(rf'(?is)<{tag}\b[^>]*>.*?</{tag}\s*>')}, ' ', 'g')"
    return out


def _part(tag: str) -> str:
    return f"nullif(regexp_extract(body, {_q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>')}, 1), '')"


_HTML = f"""raw AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), bare AS (SELECT *, {_bare('html')} AS body FROM raw), scoped AS (SELECT * REPLACE (coalesce({_part('article')}, {_part('main')}, {_part('body')}, body) AS body) FROM bare),
said AS (SELECT page_id, list_filter(list_transform(string_split_regex(body, '(?i)<p(?:\\s[^>]*)?>')[2:], lambda p: {_normal("regexp_replace(string_split_regex(p, '(?i)</p>')[1], '<[^>]*>', ' ', 'g')")}), lambda p: length(p) >= {L.MIN_PARAGRAPH})[1:{G.READ}] AS seen,
  {_normal(f"coalesce({_meta('og:title')}, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS page_title, coalesce({_meta('og:description')}, {_meta('description')}, {_meta('twitter:description')}, '') AS raw_meta, url FROM scoped),
told AS (SELECT page_id, url, page_title, {_normal(f"CASE WHEN regexp_matches(raw_meta, {_q('(?i)' + L.BOILERPLATE)}) THEN '' ELSE raw_meta END")} AS meta, list_filter(seen, lambda p: NOT regexp_matches(substr(p, 1, 160), {_q('(?i)' + L.BOILERPLATE)}))[1:{G.SHOWN}] AS paragraphs FROM said)"""
_HOST = f"trim(lower(regexp_extract(coalesce(url, ''), {_q(G.HOST)}, 1)), '[]')"
_PUBLIC = f"""host <> '' AND host <> 'localhost' AND NOT regexp_matches(host, '\\.(?:local|internal)$') AND NOT (regexp_matches(host, {_q(G.IPV4)}) AND regexp_matches(host, {_q(G.PRIVATE_IPV4)})) AND NOT (contains(host, ':') AND regexp_matches(host, {_q(G.PRIVATE_IPV6)}))"""
_FIRST = "array_to_string(string_split(page_title, ' ')[1:4], ' ')"


def _new(p: str, before: list[tuple[str, str]]) -> str:
    seen = "".join(f" AND NOT ({k} AND contains(substr(lower({q}), 1, 80), substr(lower({p}), 1, 50)))" for q, k in before)
    return f"{p} <> '' AND NOT (substr(lower({p}), 1, 60) = substr(lower(title), 1, 60) AND length({p}) < 120){seen}"


_CONTEXT = f"""{_HTML}, parts AS (SELECT page_id, {_FIRST} AS title, trim(page_title) AS a, trim(meta) AS b, coalesce(paragraphs[1], '') AS c, coalesce(paragraphs[2], '') AS d FROM told),
flags AS (SELECT *, {_new('a', [])} AS ka, {_new('b', [('a', 'ka')])} AS kb, {_new('c', [('a', 'ka'), ('b', 'kb')])} AS kc, {_new('d', [('a', 'ka'), ('b', 'kb'), ('c', 'kc')])} AS kd FROM parts),
joined AS (SELECT page_id, {_normal("concat_ws(' | ', CASE WHEN ka THEN a END, CASE WHEN kb THEN b END, CASE WHEN kc THEN c END, CASE WHEN kd THEN d END)")} AS t FROM flags),
cut AS (SELECT page_id, CASE WHEN length(t) <= {G.LIMIT} THEN t ELSE regexp_replace(CASE WHEN contains(substr(t, 1, {G.LIMIT}), ' ') THEN regexp_replace(substr(t, 1, {G.LIMIT}), ' [^ ]*$', '') ELSE substr(t, 1, {G.LIMIT}) END, '[ ,;:-]+$', '') || '...' END AS t FROM joined)"""


def _context(s: SparkSession, d: str) -> DataFrame:
    said = G.page_context(table(s, d, "pages"))
    first = F.array_join(F.slice(F.split("page_title", " "), 1, 4), " ")
    return said.select("page_id", G.build_context(F.col("page_title"), F.col("meta"), F.col("paragraphs"), first).alias("context"))


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {
        "page_context": (lambda s, d: G.page_context(table(s, d, "pages")).select("page_id", "page_title", "meta", F.array_join("paragraphs", "\n").alias("paragraphs")), f"WITH {_HTML} SELECT page_id, page_title, meta, array_to_string(paragraphs, chr(10)) AS paragraphs FROM told"),
        "built_context": (_context, f"WITH {_CONTEXT} SELECT page_id, CASE WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= {G.LEAST_LETTERS} THEN t END AS context FROM cut"),
        "public_url_filter": (lambda s, d: table(s, d, "pages").select("page_id", G.is_public_url(F.col("url")).alias("public")), f"SELECT page_id, {_PUBLIC} AS public FROM (SELECT page_id, {_HOST} AS host FROM pages)"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items() if sql}
