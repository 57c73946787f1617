"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendspark.llm.decontaminate import op6_decontaminate
from trendspark.llm.embedding_dedup import op3_embedding_dedup
from trendspark.llm.hard_negatives import op13_hard_negatives
from trendspark.llm.language_id import op1_language_id
from trendspark.llm.license_scan import op5_license_scan
from trendspark.llm.lm_scoring import op7_lm_scoring
from trendspark.llm.merkle_manifest import op12_merkle_manifest
from trendspark.llm.pii import op2_pii
from trendspark.llm.quality_mil import op9_quality_mil
from trendspark.llm.simhash_dedup import op10_simhash_dedup
from trendspark.llm.source_mixing import op8_source_mixing
from trendspark.llm.substring_dedup import op11_substring_dedup
from trendspark.llm.token_output import op4_token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        *(op1_language_id, op2_pii, op3_embedding_dedup, op4_token_output, op5_license_scan, op6_decontaminate, op7_lm_scoring),
        *(op8_source_mixing, op9_quality_mil, op10_simhash_dedup, op11_substring_dedup, op12_merkle_manifest, op13_hard_negatives),
    )
    return {f.__name__: f for f in ops}


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
found AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, i, n, w[i:i + n - 1] AS k FROM places) p JOIN win ON win.n = p.n AND win.k = p.k),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY 1),
owners AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM places),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN rep USING (k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""

#: Unsigned crc32 of decimal digits, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::UBIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), "
    "lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)), 4294967295::UBIGINT)"
)


def _tree(name: str, levels: int) -> str:
    """CTEs over {name}0(g, i, d): the nodes of each level, their runs, and n nodes in a group; a lone node stays as it is."""
    out = ""
    for k in range(levels):
        out += f"""
{name}n{k} AS (SELECT g, count(*) AS n FROM {name}{k} GROUP BY g),
{name}r{k} AS (SELECT g, i // 8 AS p, list(d ORDER BY i) AS kids, any_value(n) AS n FROM {name}{k} JOIN {name}n{k} USING (g) GROUP BY g, i // 8),
{name}{k + 1} AS (SELECT g, p AS i, CASE WHEN n = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS d FROM {name}r{k}),"""
    return out


def _climb(doc: str, runs: str, levels: int) -> str:
    """CTEs {doc}1.. over {doc}0(row, g, i, cur, path): the digest folded up the runs, and the siblings' digests so far."""
    out = ""
    for k in range(levels):
        out += f"""
{doc}{k + 1} AS (SELECT row, d.g, d.i // 8 AS i,
  CASE WHEN n = 1 THEN cur ELSE sha256(array_to_string(kids[:d.i % 8], '') || cur || array_to_string(kids[d.i % 8 + 2:], '')) END AS cur,
  path || array_to_string(kids[:d.i % 8], '') || array_to_string(kids[d.i % 8 + 2:], '') AS path
  FROM {doc}{k} d JOIN {runs}r{k} r ON d.g = r.g AND d.i // 8 = r.p),"""
    return out


def merkle_sql(levels: int = 8, group_levels: int = 3) -> str:
    """Of up to 8**levels rows of a language, and 8**group_levels languages."""
    field = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    row = " || ".join(field.format(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars", "{0}"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH leaves AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '-') AS g, lang, sha256({row.format("text")}) AS leaf,
  CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN sha256({row.format(lower)}) END AS other FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
a0 AS (SELECT g, i, leaf AS d FROM base),{_tree("a", levels)}
names AS (SELECT DISTINCT g, lang FROM leaves),
b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, d, a.g AS name FROM a{levels} a JOIN names ON a.g = names.g),{_tree("b", group_levels)}
x0 AS (SELECT row, g, i, leaf AS cur, '' AS path FROM base),{_climb("x", "a", levels)}
y0 AS (SELECT row, g, i, coalesce(other, leaf) AS cur, '' AS path FROM base),{_climb("y", "a", levels)}
s0 AS (SELECT row, 0 AS g, b0.i, cur, path FROM x{levels} x JOIN b0 ON x.g = b0.name),{_climb("s", "b", group_levels)}
t0 AS (SELECT row, 0 AS g, b0.i, cur, '' AS path FROM y{levels} y JOIN b0 ON y.g = b0.name),{_climb("t", "b", group_levels)}
root AS (SELECT d AS root FROM b{group_levels})
SELECT doc_id, leaf, x{levels}.cur AS subroot, root, sha256(s{group_levels}.path) AS proof_sha256, t{group_levels}.cur AS folded_root,
       t{group_levels}.cur = root AS verified
FROM base JOIN x{levels} USING (row) JOIN s{group_levels} USING (row) JOIN t{group_levels} USING (row), root"""


OP13_SQL = """
WITH usable AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS s
  FROM usable a JOIN usable c ON a.row <> c.row AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, vec_id NULLS LAST) <= 5),
neg AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score,
  row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.s DESC, n.vec_id NULLS LAST) AS rank
  FROM pos p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": OP6_SQL, "op11_substring_dedup": OP11_SQL, "op12_merkle_manifest": merkle_sql(), "op13_hard_negatives": OP13_SQL}
