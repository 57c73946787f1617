"""The scores by tables of n-grams against the automaton that holds all of them."""

import glob
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendspark.llm import lm_scoring
from trendspark.session import shared_dir

SF = "/root/testdata/sf0.001"


def scores(found):
    return sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in found.collect())


@pytest.mark.parametrize("core", [lm_scoring.CORE, 2e-3])  # words and n-grams known to all tasks, or by the join
def test_tables_score_as_an_automaton_of_all_grams(spark, monkeypatch, core):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    train = docs.where("doc_id % 3 > 0").select("text")
    counts, whole = lm_scoring.fit(train, core=1e-12, common=0.0)
    want = scores(lm_scoring.score_texts(docs, counts, whole))
    monkeypatch.setattr(lm_scoring, "COMMON", core)
    got = scores(lm_scoring.score_texts(docs, *lm_scoring.fit(train, core=core)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_a_gram_seen_twice_counts_at_any_size(spark):
    """501,012 tokens: three times are less than 1 / 100,000 of them, so a share of the tokens would drop the n-gram."""
    words = " ".join(f"w{i}" for i in range(500))
    rows = [(i, words) for i in range(1000)] + [(1000 + i, "w7 w3 w9") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "w7 w3 w9"), (2, "w9 w3 w7")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(asked, *lm_scoring.fit(docs.select(F.col("text")))).collect()}
    assert got[1] > got[2] + 2


def test_rounds_count_every_gram_and_leave_no_tables(spark):
    rng = np.random.default_rng(7)
    heads, tails = rng.integers(-(2**63), 2**63 - 1, (2, 1000))
    assert (lm_scoring.tail_of(lm_scoring.pair(heads, tails), heads) == tails).all()
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:300]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    said = [[*t.encode().lower().split(), b"\n"] for t in texts]
    for n in (2, 3):
        want = Counter(tuple(ws[i : i + n]) for ws in said for i in range(len(ws) - n + 1))
        found = [r for k in range(lm_scoring.rounds(n)) for r in lm_scoring.count_all_grams(frame, n, lm_scoring.bucket_bits(1), k).collect()]
        assert len({r["gram"] for r in found}) == len(found)
        assert sorted(r["c"] for r in found) == sorted(c for c in want.values() if c >= lm_scoring.LEAST)
    top = shared_dir(spark).split(":", 1)[-1]
    before = set(glob.glob(f"{top}/lm-*"))
    assert lm_scoring.op7_lm_scoring(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all("/lm-sums-" in x for x in set(glob.glob(f"{top}/lm-*")) - before)  # before, tables of all n-grams stayed


def test_rows_of_a_shuffle_keep_their_sums(spark):
    """Each round reads the texts anew; rows that come out of a shuffle come in another order each time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (-1, " \t"), (-1, " \t")], "doc_id long, text string"))
    model = lm_scoring.fit(docs.select("text"))
    want = scores(lm_scoring.score_texts(docs.where("doc_id IS NOT NULL"), *model))
    got = scores(lm_scoring.score_texts(docs.where("doc_id IS NOT NULL").repartition(7, F.rand()), *model))
    assert len(got) == len(want) and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want])
    empty = lm_scoring.fit(docs.select("text").limit(0))
    assert {r["score"] for r in lm_scoring.score_texts(docs, *empty).collect()} == {0.0}


def test_names_follow_the_tokens():
    texts = [None, "", " a  B\tÉé a\x0bb ", "x" * 3000, "\n", "b", "c d"]
    said = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    flat = [w for ws in said for w in ws]
    for skip in (0, 2):
        h, sizes = lm_scoring.named(pa.array(texts).slice(skip))
        codes, same, words = lm_scoring.coded(pa.array(texts).slice(skip))
        want = [w for ws in said[skip:] for w in ws]
        assert sizes.tolist() == same.tolist() == [len(ws) for ws in said[skip:]]
        assert h.tolist() == lm_scoring.name_words(want).tolist() and [words[k] for k in codes] == want
    assert len(set(lm_scoring.name_words(flat).tolist())) == len(set(flat))
