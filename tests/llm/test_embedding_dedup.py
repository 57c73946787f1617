"""Links and components of embeddings against all pairs."""

import numpy as np

from trendspark.llm.embedding_dedup import BLOCK, embedding_groups


def slow(rows, least=0.93):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, l in rows]
    unit = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    comp, links = list(range(len(rows))), [0] * len(rows)
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    least_id = {}
    for i, r in enumerate(rows):
        least_id[find(i)] = min((x for x in (least_id.get(find(i)), r[0]) if x is not None), default=None)
    return sorted(((r[0], links[i], least_id[find(i)]) for i, r in enumerate(rows)), key=str)


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in (0, 1):
        for size, spread in ((1, 0), (5, 0.03), (8, 0.033), (BLOCK // 2, 0.02)):
            base = rng.standard_normal(64)
            base /= np.linalg.norm(base)
            for _ in range(size):
                rows.append((k, [float(x) for x in base + spread * rng.standard_normal(64)], label))
                k += 1
    rows += [(k, rows[0][1], 0), (k + 1, None, 0), (k + 2, [0.0] * 64, 0), (k + 3, [float("nan")] * 64, 1), (k + 4, rows[0][1], None), (k + 5, [1.0, 0.0], 0), (k + 6, [1.0, 0.001], 0), (k + 7, [1.0, None], 0), (k + 8, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n", "'x' AS cls")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_groups(df).collect()), key=str)
    want = slow(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found <= there and found >= 0.99 * there  # filters may miss a pair near the threshold, never invent one
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(rows)
    assert embedding_groups(df.where("false")).collect() == []


def test_labels_of_any_type_and_double_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0], "a"), (2, [1.0, 0.1, 0.0, 0.0], "a"), (3, [1.0, 0.0, 0.0, 0.0], "b"), (4, [1e-200, 0.0, 0.0, 0.0], "a"), (5, [1.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_groups(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1), (5, 0, 5)]
