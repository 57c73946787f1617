"""SimHash groups against all pairs, and the defined results of odd inputs."""

import numpy as np
import pytest
import xxhash

from trendspark.llm.simhash_dedup import dedup, fingerprint_links, op10_simhash_dedup, simhash_groups, turned, walk

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, prints[i], least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_whole_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in op10_simhash_dedup(spark, SF).collect()), key=str)
    assert got == slow_groups(rows)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "ONE\ttwo"), (2, "ONE\ttwo"), (None, "one two"), (None, "quite another text of six words"), (7, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS root")
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash_groups(df).collect()), key=str)
    assert got == slow_groups(rows)
    kept = dedup(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in kept.collect()) == [("1", "One two"), ("3", ""), ("7", "x x x x x"), ("None", "quite ano")]
    assert simhash_groups(df.where("false")).collect() == [] == dedup(df.where("false")).collect()


@pytest.mark.parametrize("subtree", [4, 64, 100_000])
def test_trie_join_finds_all_pairs(spark, subtree):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in np.repeat(base, 6)]
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64), np.arange(64, dtype=np.uint64), [np.uint64(2**64 - 1)]]))
    i, j = (np.concatenate(x) for x in zip(*walk(fps, np.array([0]), np.array([len(fps)]), 0, 2), strict=True))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1)), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    links = fingerprint_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 2, subtree).collect()
    index = {int(x): k for k, x in enumerate(fps.view(np.int64))}

    def components(edges):
        c = list(range(len(fps)))
        find = lambda x: x if c[x] == x else find(c[x])
        for a, b in edges:
            c[find(a)] = find(b)
        groups = {}
        for x in range(len(fps)):
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    assert components([(index[r["src"]], index[r["dst"]]) for r in links]) == components(want)


def test_each_trie_turns_another_block_to_the_front():
    fps = np.random.default_rng(5).integers(0, 2**63, 50, dtype=np.uint64)
    for trie, depth in ((1, 21), (2, 21), (3, 21), (1 + 4 * 2, 35), (3 + 4 * 3 + 16 * 2, 44)):
        x, bits = turned(fps, trie, 2)
        assert bits == depth and sorted(np.bitwise_count(x)) == sorted(np.bitwise_count(fps)) and len(np.unique(x)) == 50
    assert (turned(fps, 2, 2)[0] >> np.uint64(43) == (fps >> np.uint64(22)) & np.uint64(2**21 - 1)).all()
