"""Queries over groups of vectors, with the recursive DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendspark.operators.vectors import vector_groups
from trendspark.session import table

#: The least similarity of a pair in a group of the table's vectors, and of a member to its centroid.
LINKAGE, LEAST = 0.3, 0.55

_UNITS = """u AS (SELECT CAST(label AS VARCHAR) AS block, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth,
  list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"""
#: From pairs of parts apart the least distance joins two; both of two or more make leaves of those that never split.
_LEAVES = f"""{_UNITS}, pairs AS (SELECT a.block, a.nth AS low, b.nth AS high, row_number() OVER (PARTITION BY a.block ORDER BY list_inner_product(a.v, b.v) DESC, a.nth, b.nth) AS place FROM u a JOIN u b ON a.block = b.block AND a.nth < b.nth),
tree AS (
  SELECT block, list(nth ORDER BY nth) AS home, list(false) AS split, []::BIGINT[][] AS leaves, 0 AS step FROM u GROUP BY 1
  UNION ALL
  SELECT block, list_transform(home, lambda h: CASE WHEN h = b THEN a ELSE h END), list_transform(split, lambda s, i: CASE WHEN i = a THEN s OR split[b] OR na >= 2 AND nb >= 2 ELSE s END),
    CASE WHEN na >= 2 AND nb >= 2 THEN list_concat(leaves, list_concat(CASE WHEN split[a] THEN [] ELSE [of_a] END, CASE WHEN split[b] THEN [] ELSE [of_b] END)) ELSE leaves END, step + 1
  FROM (SELECT *, len(of_a) AS na, len(of_b) AS nb FROM (SELECT *, list_filter(range(1, len(home) + 1), lambda i: home[i] = a) AS of_a, list_filter(range(1, len(home) + 1), lambda i: home[i] = b) AS of_b
    FROM (SELECT t.block, any_value(home) AS home, any_value(split) AS split, any_value(leaves) AS leaves, any_value(step) AS step, arg_min(home[low], place) AS a, arg_min(home[high], place) AS b
      FROM tree t JOIN pairs p ON p.block = t.block AND home[low] <> home[high] GROUP BY t.block)))),
found AS (SELECT block, unnest(leaf) AS nth, leaf[1] AS leaf FROM (SELECT block, unnest(leaves) AS leaf FROM (SELECT * FROM tree QUALIFY step = max(step) OVER (PARTITION BY block))))"""
_ORDERED = f"""{_UNITS}, pairs AS (SELECT a.block, a.nth AS low, b.nth AS high, list_inner_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.block = b.block AND a.nth < b.nth WHERE list_inner_product(a.v, b.v) >= {LINKAGE}),
sizes AS (SELECT block, count(*) AS n FROM u GROUP BY 1),
steps AS (
  SELECT block, 0::BIGINT AS nth, []::BIGINT[] AS home FROM sizes
  UNION ALL
  SELECT s.block, s.nth + 1, list_append(s.home, coalesce(b.g, s.nth + 1)) FROM steps s JOIN sizes z ON z.block = s.block AND s.nth < z.n LEFT JOIN (
    SELECT block, arg_min(g, (-worst, g)) AS g FROM (SELECT s.block, s.home[p.low] AS g, min(sim) AS worst, count(*) AS n, any_value(len(list_filter(s.home, lambda h: h = s.home[p.low]))) AS size
      FROM steps s JOIN pairs p ON p.block = s.block AND p.high = s.nth + 1 GROUP BY 1, 2 HAVING count(*) = any_value(len(list_filter(s.home, lambda h: h = s.home[p.low])))) GROUP BY 1) b ON b.block = s.block),
found AS (SELECT block, nth, leaf FROM (SELECT block, unnest(range(1, len(home) + 1)) AS nth, unnest(home) AS leaf FROM (SELECT * FROM steps QUALIFY nth = max(nth) OVER (PARTITION BY block))) QUALIFY count(*) OVER (PARTITION BY block, leaf) >= 2)"""


def _gated(found: str, least: float) -> str:
    """Of groups `found` (block, nth, leaf) the least similar member to the centroid goes, step by step, until all reach least."""
    centre = "SELECT block, leaf, list(m ORDER BY i) AS c FROM (SELECT block, leaf, i, avg(x) AS m FROM (SELECT block, leaf, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {0}) GROUP BY 1, 2, 3) GROUP BY 1, 2"
    sims = "SELECT g.*, round(list_inner_product(v, c) / sqrt(list_inner_product(c, c)), 9) AS sim FROM {0} g JOIN (" + centre + ") USING (block, leaf)"
    return f"""WITH RECURSIVE {found}, members AS (SELECT u.block, leaf, u.nth, vec_id, v FROM u JOIN found f ON f.block = u.block AND f.nth = u.nth),
gate AS (
  SELECT block, leaf, nth, vec_id, v, 0 AS step FROM members
  UNION ALL
  SELECT block, leaf, nth, vec_id, v, step + 1 FROM (SELECT *, min(sim) OVER g AS worst, row_number() OVER (g ORDER BY sim, nth) AS place, count(*) OVER g AS n FROM ({sims.format("gate")}) WINDOW g AS (PARTITION BY block, leaf))
  WHERE worst < {least} AND n >= 2 AND place > 1),
last AS (SELECT * FROM gate QUALIFY step = max(step) OVER (PARTITION BY block, leaf)),
kept AS (SELECT block, nth, min(vec_id) OVER (PARTITION BY block, leaf) AS group_id, CAST(row_number() OVER (PARTITION BY block, leaf ORDER BY sim DESC, nth) AS INT) AS place FROM ({sims.format("last")}) QUALIFY count(*) OVER (PARTITION BY block, leaf) >= 2)
SELECT u.block, vec_id, group_id, place FROM u LEFT JOIN kept USING (block, nth)"""


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    given = f"{_UNITS}, found AS (SELECT block, nth, 0 AS leaf FROM u)"
    groups = lambda method, least: lambda s, d: vector_groups(table(s, d, "embeddings"), "label", method, least, LINKAGE)
    return {
        "density_groups": (groups("density", LEAST), _gated(_LEAVES, LEAST)),
        "threshold_groups": (groups("threshold", LEAST), _gated(_ORDERED, LEAST)),
        "cosine_gate_iterative": (groups("given", 0.1), _gated(given, 0.1)),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items()}
