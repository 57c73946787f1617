"""Pairs at the least cosine are found however many filters there are."""

import numpy as np

from trendspark.llm import embedding_dedup

PAIRS = 1500


def test_recall_with_the_filters_of_a_large_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((2, PAIRS, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(2 * i + j, x[i].tolist(), 0) for i in range(PAIRS) for j, x in enumerate((a, b))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embedding_dedup, "_words", lambda n: 256)  # as of 786,000 vectors
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_groups(df).collect()}
    assert set(got.values()) <= {0, 1}
    assert sum(got.values()) >= 2 * (PAIRS - 5)


def test_all_pairs_meet_in_few_dimensions(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = sum(r["n_links"] for r in embedding_dedup.embedding_groups(df).collect())
    assert got == (x.astype(np.float32) @ x.astype(np.float32).T >= 0.93).sum() - len(x)
