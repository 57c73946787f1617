"""Hard negatives against all inner products, with small shards and buckets."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trendspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, is_anchor, low=80, k=5):
    usable = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 2**23 for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**62:
            usable.append((i, q, label))
    order = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(usable):
        if not is_anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other) for b, (j, w, other) in enumerate(usable) if b != a and len(w) == len(v)]
        first = lambda some: sorted(some, key=lambda s: (-s[0], order(s[1])))[:k]
        for ps, p, _ in first([s for s in scored if s[2] == label]):
            fits = [s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= 100 * ps]
            out += [(i, p, rank, j, ps, s) for rank, (s, j, _) in enumerate(first(fits), start=1)]
    return sorted(out, key=repr)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in H.mine(df, F.col("vec_id") % 3 == 0, **more).collect()), key=repr)
    assert got == plain(rows, lambda i: i is not None and i % 3 == 0, k=more.get("k", 5))
    return got


def test_norms_labels_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 40)
    monkeypatch.setattr(H, "ANCHORS", 16)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = rng.standard_normal(6) * rng.choice([0.1, 1, 1, 3])
        rows.append((i, np.round(v * 4).tolist() if i % 2 else v.tolist(), int(rng.integers(0, 3))))
    rows += [(400 + k, rows[k % 40][1], k % 3) for k in range(120)]  # repeated vectors: ties
    assert len(check(spark, rows)) > 1000
    check(spark, rows[:90], k=2)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 8)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.5, 1.0, -0.25]) for _ in range(4)], rng.randrange(2)) for i in range(30)]
    rows += [(None, [0.5] * 4, 1), (None, [0.5] * 4, 0), (3, None, 1), (6, [0.5, None, 0.5, 0.5], 1), (9, [math.nan] * 4, 1), (12, [math.inf] * 4, 0), (15, [0.5] * 4, None)]
    rows += [(18, [0.0] * 4, 0), (21, [], 1), (24, [], 1), (27, [], 0), (30, [1.0, 2.0], 0), (33, [1.0, 2.0], 0), (34, [1.0, 2.0], 1), (36, [8_000_000.0] * 4, 1), (37, [7_999_999.0] * 4, 1), (38, [7_999_000.0] * 4, 0), (39, [1e30] * 4, 1)]
    rows += rows[:6]
    check(spark, rows)
    check(spark, [])
    check(spark, [(3, [1.0], 1)])
    clashing = spark.createDataFrame([(3, [1.0], 1), (4, [1.0], 1), (5, [1.0], 2)], SCHEMA).withColumn("row", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("query", F.lit(None).cast("string"))
    assert [tuple(r) for r in H.mine(clashing, F.col("vec_id") == 3).collect()] == [(3, 4, 1, 5, 65536, 65536)]


def test_a_bucket_below_the_limit_is_not_read():
    """Rows of the second bucket are too short for the window; the first five of the first bucket are the result."""
    n = H.BUCKET + 3
    shard = pa.table({"row": range(n), "id": range(n), "label": ["a"] * n, "squared": [10_000] * H.BUCKET + [1] * 3, "vector": pa.array([[100, 0]] * H.BUCKET + [[1, 0]] * 3, pa.list_(pa.int64()))})
    query = pa.table({"query": [7], "own": [10**6], "label": ["b"], "squared": [10_000], "vector": pa.array([[100, 0]], pa.list_(pa.int64())), "low": [8000], "high": [10_000], "floor": [-(1 << 63)], "same": [False]})
    assert [(q, i, s) for q, _, i, s in H.tile(query, shard, 5)] == [(7, i, 10_000) for i in range(5)]
