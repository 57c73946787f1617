"""Operators over texts: SQL, brute force, round trips, held-out accuracy, and odd inputs."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trendspark.llm import decontaminate, language_id, license_scan, lm_scoring, quality_mil, queries, source_mixing, token_output
from trendspark.session import scratch_path

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 !!"), (5, "é"), (5, "é"), (None, "word"), (7, "long " * 60_000), (8, "ends with \x01 and <|startoftext|>  x")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'a' AS lang", "1 AS n_words", "'k' AS key", "2.0 AS rate", "0 AS n")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_decontamination_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()["op6_decontaminate"])
    names = [c[0] for c in want.description]
    got = decontaminate.op6_decontaminate(spark, SF)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_decontamination_in_parts_and_odd_texts(spark, odd):
    bench = spark.createDataFrame([(1, "One two"), (2, None), (3, "!"), (4, " ".join(f"w{i}" for i in range(20))), (1, "One two")], "item_id long, text string")
    texts = [(0, "say ONE, two!"), (1, "x " + " ".join(f"W{i}" for i in range(3, 17)) + " y"), (2, " ".join(f"w{i}" for i in range(12)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for most in (4_000_000, 1):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in decontaminate.find_contamination(df, bench, most_words=most).collect()}
        assert got[0] == (3, 2, [1], [(4, 12)]) and got[1][:3] == (16, 14, [4]) and got[2] == (12, 0, [], [])
        assert texts[1][1][slice(*got[1][3][0])] == texts[1][1][2:-2]
    assert sorted(r["n_words"] for r in decontaminate.find_contamination(odd, bench).collect()) == [0, 0, 0, 1, 1, 1, 1, 5, 60_000]
    assert decontaminate.find_contamination(odd.where("false"), bench).collect() == []


def test_token_shards_round_trip(spark, docs, odd):
    path = public_tokenizers.path(token_output.TOKENIZER)
    whole = Tokenizer.from_file(path)
    for df in (docs, odd):
        rows = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        shards = token_output.write_tokens(df, scratch_path(spark, "t"), path, shard_ids=50_000)
        got = sorted((r.asDict() for r in token_output.read_tokens(spark, shards, True).collect()), key=lambda r: r["start"])
        at = 0
        for (doc_id, text), r in zip(rows, got, strict=True):
            ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, at, len(ids), ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += len(ids)
    assert token_output.read_tokens(spark, token_output.write_tokens(docs.where("false"), scratch_path(spark, "t"), path)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 700, 70_000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    for top in (1, n, 2**40):
        v = np.sort(rng.integers(0, top, n))
        ef = token_output.EliasFano(n, *token_output.EliasFano.encode(v))
        assert (ef.some(0, n) == v).all() and (ef.some(n // 3, n // 2) == v[n // 3 : n // 2]).all() and all(ef.get(i) == v[i] for i in rng.integers(0, n, 20).tolist())


def test_language_of_held_out_texts(spark, docs, odd):
    got = {r["doc_id"]: r for r in language_id.op1_language_id(spark, SF).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    model = language_id.fit(docs)
    assert [r["lang_pred"] == "und" for r in language_id.identify(odd.orderBy(F.asc_nulls_last("doc_id")), model).orderBy(F.asc_nulls_last("doc_id")).collect()] == [True] * 4 + [False] * 5
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(docs.where("false"))).collect()} == {"und"}


def test_suffix_automaton_knows_exactly_the_substrings():
    x = np.random.default_rng(2).integers(0, 3, 60).astype(np.uint8)
    to = language_id.suffix_automaton(x)
    y = np.random.default_rng(3).integers(0, 3, 200).astype(np.uint8)
    s, n, i = bytes(x), 0, 0
    while i < len(y):
        k = 1
        while i + k <= len(y) and bytes(y[i : i + k]) in s:
            k += 1
        n, i = n + 1, i + max(1, k - 1)
    assert language_id.phrases(to, y[:, None], np.array([len(y)])).tolist() == [n]


def test_language_model_counts_and_probabilities(spark, docs, odd):
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in lm_scoring.op7_lm_scoring(spark, SF).collect()}
    said = {r["doc_id"]: r["text"].encode().lower().split() + [b"\n"] for r in rows}
    c = collections.Counter(w for d, ws in said.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in said.items():
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[d]["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])
    counts, model = lm_scoring.fit(docs.select("text"), core=2e-4, common=1e-3)  # most tokens by the join
    a = model["automaton"]
    for state in range(len(a.fail)):  # each context's probabilities sum to one, core words and the rest
        p, _ = a.step(np.full(a.width, state), np.arange(a.width))
        rest, _ = a.step(np.array([state]), np.array([-1]))
        other = 1 - (10**a.root).sum()
        assert (10**p).sum() + 10 ** rest[0] * other == pytest.approx(1, abs=1e-6)
    found = lm_scoring.score_texts(odd, counts, model).collect()
    assert sorted(r["n_tokens"] for r in found) == [1, 1, 1, 2, 2, 2, 3, 7, 60_001]


def test_quality_of_held_out_labels(spark, odd):
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in quality_mil.op9_quality_mil(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == q for p, q in got) >= 0.95 * len(got)
    assert len(quality_mil.score_quality(odd, None).collect()) == len(ODD)


def test_attention_gradients():
    rng = np.random.default_rng(4)
    x, n, y = rng.standard_normal((7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    m = quality_mil.AttentionMIL(np.zeros(5), np.ones(5), 0.5)
    m.p["c"] = rng.standard_normal(quality_mil.HIDDEN)
    loss = lambda: -np.mean([np.log(o if t else 1 - o) for o, t in zip(m.forward(x, n)[0], y, strict=True)])
    g = m.gradients(x, n, y)
    for k in m.p:
        at = tuple(rng.integers(0, s) for s in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-6
        up = loss()
        m.p[k][at] = old - 1e-6
        down = loss()
        m.p[k][at] = old
        assert (up - down) / 2e-6 == pytest.approx(g[k][at], abs=1e-5)


def test_mixing_reaches_its_targets(spark, docs, odd):
    labels = docs.select("doc_id", F.when(F.col("lang") == "en", "en").otherwise("other").alias("domain"))
    model = source_mixing.fit_domains(docs, labels)
    rated, info = source_mixing.mix(docs, model, {"en": 0.5, "other": 0.5}, keep=0.6, most=1.0)
    assert info["residual"] < 2e-3 and all(0 <= r["rate"] <= 1 for r in rated.collect())
    drawn = source_mixing.draw(docs, model, {"en": 0.5, "other": 0.5}, keep=0.6)
    want = [r["doc_id"] for r in rated.withColumn("c", source_mixing.copies(F.col("rate"), F.col("doc_id"), F.col("key"))).where("c = 1").collect()]
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(want) and drawn.columns == docs.columns
    assert len(source_mixing.mix(odd, model, {"en": 1.0})[0].collect()) == len(ODD)
    assert source_mixing.fit_domains(docs, labels.where("false"))["names"] == []


def test_license_notices(spark, docs, odd):
    got = {(r["doc_id"], r["license"]) for r in license_scan.op5_license_scan(spark, SF).collect()}
    words = lambda t: t.encode().translate(decontaminate._FOLD).split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for r in docs.collect():
        for line in r["text"].split("\n"):
            for name, notice in license_scan.NOTICES.items():
                t = grams(words(notice))
                if len(t & grams(words(line))) >= 0.8 * len(t):
                    want.add((r["doc_id"], name))
    assert got == want and want
    assert license_scan.scan_licenses(odd).collect() == []


def test_whole_licenses_are_found_where_they_stand(spark):
    fill = " ".join(f"word{i}" for i in range(400))
    long = " ".join(f"clause{i * 7919 % 6007} of {i}" for i in range(2000))
    own = license_scan.NOTICES | {"long": long}
    rows = []
    for name, text in own.items():
        rows += [(name, f"{fill} {text.upper()} {fill}"), (name, f"{text}"), (name, " ".join(text.split()[: len(text.split()) // 2]))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan_licenses(df, own).collect()}
    for i, (name, text) in enumerate(rows):
        if i % 3 == 2:
            assert (i, name) not in got
        else:
            r = got[i, name]
            assert r["containment"] == 1.0 and text[r["start"] : r["end"]].lower().split()[:3] == own[name].lower().strip(" \n<").split()[:3]
    text = own["mit-text"].split()
    twice = spark.createDataFrame([(1, " ".join(text[:10] + ["other"] + text[10:]))] * 2 + [(None, "\n".join(text[6:]))], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in license_scan.scan_licenses(twice).where("license = 'mit-text'").collect()) == ["1", "1", "None"]


def test_pipeline_stages(spark, docs):
    was = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, was, SF)
        assert now.columns == docs.columns and 0 < now.count() <= was.count()
        was = now
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
