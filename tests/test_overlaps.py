"""Groups and pairs by shared tokens over tiles against all pairs in plain Python."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trendspark.functions import text as X
from trendspark.operators import graph
from trendspark.operators import items as I
from trendspark.operators import links as K
from trendspark.operators import overlaps as O


def titles(seed, n=170):
    """Few frequent and many rare words, titles of one to twelve of them, copies, and titles without a token."""
    rng = random.Random(seed)
    words = [f"w{a}{b}" for a in "abcdefghijkl" for b in "mnopqrstuvwxyz"]
    out = [" ".join(rng.choices(words, [40 / (i + 1) for i in range(len(words))], k=rng.choice([1, 1, 2, 3, 6, 9, 12]))) for _ in range(n)]
    return [(7 * i + 1, t) for i, t in enumerate([*out, out[0], out[3], "", None, "the of", "wholly alone"])]


def plain_groups(tokens):
    n = len(tokens)
    df = Counter(t for ts in tokens.values() for t in ts)
    rare_cap, short_cap = max(4, 6 * n // 100), max(6, n // 10)
    root = {i: i for i in tokens}
    for a, b in combinations(sorted(tokens), 2):
        both = tokens[a] & tokens[b]
        rare, few, least = sum(df[t] <= rare_cap for t in both), sum(df[t] <= short_cap for t in both), min(len(tokens[a]), len(tokens[b]))
        if any(df[t] <= max(short_cap, 12) for t in both) and (len(both) / len(tokens[a] | tokens[b]) >= 0.34 or rare >= 2 or rare and least <= 2 or few and least <= 2):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return root


def of(items):
    return {r["item_id"]: set(r["t"] or ()) for r in items.select("item_id", X.significant_tokens(F.col("title")).alias("t")).collect()}


@pytest.mark.parametrize("seed, tile", [(1, 8192), (2, 23), (3, 7)])
def test_lexical_groups(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(O, "TILE", tile)
    monkeypatch.setattr(O, "MET", 50 if tile == 7 else 1 << 20)
    monkeypatch.setattr(graph, "SMALL", 0 if seed == 2 else 100_000)
    items = spark.createDataFrame(titles(seed), "item_id long, title string")
    want = plain_groups(of(items))
    assert 3 < len(set(want.values())) < 120
    assert {r["item_id"]: r["group_id"] for r in K.lexical_groups(items).collect()} == want


def test_groups_stay_inside_runs(spark):
    some, more = titles(4, 60), [(10_000 + i, t) for i, t in titles(4, 60)]
    runs = spark.createDataFrame([(i, t, "a") for i, t in some] + [(i, t, "b") for i, t in more], "item_id long, title string, run string")
    alone = {r["item_id"]: r["group_id"] for r in K.lexical_groups(runs.where("run = 'a'")).collect()}
    assert {r["item_id"]: r["group_id"] for r in K.lexical_groups(runs, run="run").collect()} == alone | {10_000 + i: 10_000 + g for i, g in alone.items()}


@pytest.mark.parametrize("tile", [8192, 11])
def test_link_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(O, "TILE", tile)
    items = spark.createDataFrame(titles(5), "item_id long, title string")
    tokens = of(items)
    df = Counter(t for ts in tokens.values() for t in ts)
    rare = {t for t, n in df.items() if n <= max(12, len(tokens) // 10)}
    want = {}
    for a, b in combinations(sorted(tokens), 2):
        n = len(tokens[a] & tokens[b] & rare)
        if n >= 2 and n / (len(tokens[a]) + len(tokens[b]) - n) >= 0.25:
            want[a, b] = n
    got = I.link_pairs(items.select("item_id", X.significant_tokens(F.col("title")).alias("tokens"))).collect()
    assert want and len(got) == len(want) and {(r["left_id"], r["right_id"]): r["shared"] for r in got} == want


def test_no_pair_is_shuffled(spark):
    """400 items with one token in common: 79,800 pairs, none of which leaves its task; before, each was a row of a shuffle."""
    items = spark.range(4000).select("id", F.when(F.col("id") < 400, F.array(F.lit("hot"), F.concat(F.lit("t"), "id"))).otherwise(F.array(F.concat(F.lit("t"), "id"), F.concat(F.lit("u"), "id"))).alias("tokens"))
    found = I.link_pairs(items.withColumnRenamed("id", "item_id"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and found.count() == 0


def test_proposals_meet_names_of_their_own_draft(spark):
    """Items and drafts of one name never meet all with all; before, each of 60 items met each of 60 drafts of its name."""
    n = 60
    proposed = spark.createDataFrame([(i, 1000 + (i * 7) % 90) for i in range(n)] + [(i, 1000 + i) for i in range(n)], "item_id long, draft_id long")
    names = spark.createDataFrame([(1000 + i, "oak" if i % 2 else "elm") for i in range(n)], "draft_id long, entity_key string")
    named = spark.createDataFrame([(i, "oak") for i in range(n)] + [(i, "ash") for i in range(n)], "item_id long, entity_key string")
    links = spark.createDataFrame([(0, 500), (501, 2)], "left_id long, right_id long")
    members = spark.createDataFrame([(500, 1000), (501, 1014)], "item_id long, draft_id long")
    found = K.supported(proposed, links, members, names, named)
    want = {(i, d) for i, d in map(tuple, proposed.collect()) if d < 1000 + n and d % 2 or (i, d) in {(0, 1000), (2, 1014)}}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "entity_key" in line]
    assert joins and all("draft_id" in line for line in joins)
