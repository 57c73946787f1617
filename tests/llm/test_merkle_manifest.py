"""The manifest against a tree built from lists, with many small partitions."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from trendspark.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, at, own):
    """The root over level with `own` in place of its node `at`, and the siblings on the way."""
    siblings = []
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        run = runs[at // 8]
        siblings += run[: at % 8] + run[at % 8 + 1 :]
        own = h(*run[: at % 8], own, *run[at % 8 + 1 :])
        level, at = [h(*r) for r in runs], at // 8
    return own, siblings


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops.append(climb([leaf(r) for r in groups[g]], 0, leaf(groups[g][0]))[0])
    out = []
    for k, g in enumerate(order):
        level = [leaf(r) for r in groups[g]]
        for i, r in enumerate(groups[g]):
            subroot, below = climb(level, i, level[i])
            root, above = climb(tops, k, subroot)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            lower = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            other = leaf((*r[:4], lower)) if bad else level[i]
            folded = climb(tops, k, climb(level, i, other)[0])[0]
            out.append((r[0], level[i], subroot, root, h(*below, *above), folded, folded == root))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.manifest(df, tampered=M.crc_bucket(F.col("doc_id"), 3) == 0)
    return got, sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.leaves.collect()), key=repr)


def test_trees_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 7)
    rng = random.Random(2)
    rows, key = [], 0
    for n, lang in ((1, "a"), (2, "b"), (7, "c"), (8, "d"), (9, "B"), (64, "é"), (65, ""), (73, None), (20, "zz"), (17, "z")):
        for _ in range(n):
            key += rng.randint(1, 5)
            rows.append((key, rng.choice(["s", None]), lang, rng.choice([3, None]), rng.choice(["Upper", "lower", "É ü", "", None, "X" * 3000])))
    rng.shuffle(rows)
    got, leaves = found(spark, rows)
    assert leaves == plain(rows)
    assert got.groups.count() == 10 and got.groups.select("root").distinct().count() == 1
    assert any(not r[6] for r in leaves) and any(r[6] for r in leaves)
    # every node that partitions joined is one of the tree
    roots = {r["digest"] for r in got.seams.where("level = depth").collect()}
    assert roots == {r[2] for r in leaves}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 4)
    rows = [(None, None, None, None, None), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "A"), (5, "s", "en", 1, "B"), (None, "s", "en", 1, "A"), (-3, "", "en", 0, "")] + [(9, "x", "en", 2, "same")] * 30
    assert found(spark, rows)[1] == plain(rows)
    assert found(spark, [(1, "s", "en", 1, "A")])[1] == plain([(1, "s", "en", 1, "A")])
    got, leaves = found(spark, [])
    assert leaves == [] and got.groups.collect() == []


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "en", "T", "x")], "doc_id long, lang string, text string, leaf string").withColumn("row", F.lit(3)).withColumn("slot", F.lit("q"))
    (r,) = M.manifest(df, ("doc_id", "text")).leaves.collect()
    assert r["leaf"] == h("1:1", "1:T") == r["root"] and r["verified"] and r["proof_sha256"] == h()


def test_ranges_carry():
    for start in (0, 3, 8, 60):
        for n in (1, 7, 8, 9, 70, 200):
            r = M.Range(start)
            for i in range(n):
                r.push(h(str(start + i)))
            edges = r.close()
            assert all(len([e for e in edges if e.level == k]) <= 14 for k in range(5))
            whole = {(x.level, x.index) for x in r.nodes}
            assert all((lv + 1, i // 8) not in whole for lv, i, _ in edges)
            assert {(lv, i) for lv, i in whole if lv == 1} == {(1, k) for k in range(64) if start <= 8 * k and 8 * k + 8 <= start + n}
