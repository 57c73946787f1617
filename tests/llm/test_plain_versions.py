"""Queries and pipeline stages against plain versions of what they compute, on small tables and odd ones."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trendspark.llm import decontaminate, language_id, quality_mil, simhash_dedup, source_mixing
from trendspark.llm.common import crc_bucket
from trendspark.llm.textstats import CLASSES, words_of

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 !!"), (5, "é"), (5, "é"), (None, "word"), (7, "long " * 60_000), (8, "two words here")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_phrases(sample: str, text: str) -> int:
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        n, i = n + 1, i + max(1, k - 1)
    return n


def test_language_of_whole_texts_by_plain_cross_parsing(spark, docs, monkeypatch):
    samples = {}
    build = language_id.suffix_automaton
    monkeypatch.setattr(language_id, "suffix_automaton", lambda codes: samples.setdefault(len(samples), (bytes(codes), build(codes)))[1])
    languages, automata, codes = language_id.fit(language_id.training_rows(docs), letters_each=600)
    table = codes.table()
    got = {r["doc_id"]: r for r in language_id.identify(docs, (languages, automata, codes)).collect()}
    for r in docs.collect():
        code = table[language_id._points(r["text"] or "")]
        keep = code != 0
        keep[1:] |= code[:-1] != 0
        x = bytes(code[keep])
        cost = []
        for k in range(len(languages)):
            sample, to = samples[k]
            n = sum(plain_phrases(sample, x[a : a + language_id.BLOCK]) for a in range(0, len(x), language_id.BLOCK))
            cost.append(n * np.log2(max(2, len(to) / 2)) / max(1, len(x)))
        some = (code != 0).any()
        best = int(np.argmin(cost))
        assert got[r["doc_id"]]["lang_pred"] == (languages[best] if some else "und")
        second = sorted(cost)[1]
        assert got[r["doc_id"]]["lang_score"] == pytest.approx(1 - cost[best] / second / 2 if some else 0)


def test_languages_that_tie_and_many_languages(spark):
    same = [(1, "abc abd", "b"), (2, "abc abd", "a"), (3, "abc", None)]
    df = spark.createDataFrame(same, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert set(got.values()) == {("a", 0.5)}
    many = spark.createDataFrame([(i, chr(0x4E00 + 20 * i) * 10, f"l{i:03d}") for i in range(90)], "doc_id long, text string, lang string")
    model = language_id.fit(many)
    assert len(model[0]) == 90
    assert all(r["lang"] == r["lang_pred"] for r in language_id.identify(many, model).collect())


def test_quality_of_each_text_by_a_plain_forward_pass(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(crc_bucket(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    m = quality_mil.fit(docs.select("doc_id", "text"), labels)
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x"))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["score"]) for r in quality_mil.score_quality(both, m).collect())
    p, want = m.p, []
    for r in both.collect():
        x, n = quality_mil.passages([(r["text"] or "").encode()])
        words = len((r["text"] or "").split(" ")) if r["text"] else 0
        assert len(x) == n[0] >= 1 and (words < 10 or len(x) <= words)
        x = np.clip((x - m.mean) / m.scale, -8, 8)
        h = [np.tanh(row @ p["E"] + p["e"]) for row in x]
        a = np.array([(np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in h])
        a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        z = sum(w * v for w, v in zip(a, h, strict=True))
        want.append((r["doc_id"] is not None, r["doc_id"] or 0, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-5)
    assert quality_mil.score_quality(both.where("false"), m).collect() == []


def test_words_and_classes_of_long_texts_in_pieces():
    texts = [b"One two", b"", b"x" * 400_000 + b" y", b"ab " * 200_000, b" 1!"]
    w = words_of(texts)
    assert w.n.tolist() == [2, 0, 2, 200_000, 1]
    for i, t in enumerate(texts):
        alone = words_of([t])
        assert (alone.hash == w.hash[w.text == i]).all()
    counts = np.zeros(CLASSES, dtype=int)
    np.add.at(counts, w.bytes_class, 1)
    assert counts[2] == 1 and counts[3] == 1 and counts[8] == 1 and counts[0] == 0


def plain_rates(p, n, want, most):
    """Projected gradient of the same least squares, without acceleration, over gathered rows."""
    natural, r = (n[:, None] * p).sum(axis=0) / n.sum(), np.ones(len(p))
    for _ in range(20_000):
        off = (r * n) @ p / n.sum() - want
        r = np.clip(r - p @ (off / natural), 0, most)
    return r


def test_rates_reach_what_a_plain_solver_reaches(spark, docs):
    labels = source_mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    model = source_mixing.fit_domains(docs, labels)
    assert len(model["names"]) == labels.where("domain IS NOT NULL").select("domain").distinct().count()
    for targets, keep, most in ((source_mixing.TARGETS, source_mixing.KEEP, source_mixing.MAX_RATE), ({"quality0_toxic0": 1.0}, 0.9, 1.0)):
        found, info = source_mixing.mix(docs, model, targets, keep, most)
        rows = found.collect()
        p, n = np.array([r["posterior"] for r in rows]), np.array([float(r["n_tokens"]) for r in rows])
        want = np.array([info["want"][k] for k in model["names"]])
        plain = plain_rates(p, n, want, most)
        reached = {"plain": (plain * n) @ p / n.sum(), "own": np.array([r["rate"] for r in rows]) * n @ p / n.sum()}
        assert reached["own"] == pytest.approx(np.array([info["reached"][k] for k in model["names"]]), abs=1e-9)
        natural = (n[:, None] * p).sum(axis=0) / n.sum()
        loss = {k: (((x - want) ** 2) / natural).sum() for k, x in reached.items()}
        assert loss["own"] <= loss["plain"] * 1.05 + 1e-5
        assert (info["residual"] <= 2 * source_mixing.CLOSE) == (most > 1)
    with pytest.raises(ValueError, match="rates"):
        source_mixing.mix(docs, model, {"quality0_toxic0": 1.0}, 0.9, 1.0, strict=True)


def test_many_domains_are_all_learned(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 70).cast("string").alias("domain"))
    assert len(source_mixing.fit_domains(docs, labels)["names"]) == 70


CLASH = ["n_words", "n_hit", "items", "spans", "lang_pred", "lang_score", "lang_bits", "posterior", "rate", "key", "fp", "component_id"]


@pytest.fixture
def clashing(spark, docs):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'src1' AS source", "CAST(0 AS BIGINT) AS n_chars")
    rows = docs.selectExpr("doc_id", "text", "lang", "source", "CAST(n_chars AS BIGINT) AS n_chars").unionByName(odd)
    return rows.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in CLASH])


def test_stages_keep_what_a_plain_version_keeps(spark, docs, clashing):
    key = lambda df: sorted((str(r["doc_id"]), (r["text"] or "-")[:40], *(str(r[c]) for c in CLASH)) for r in df.collect())
    every = clashing.collect()
    own = lambda rows: sorted((str(r["doc_id"]), (r["text"] or "-")[:40], *(str(r[c]) for c in CLASH)) for r in rows)

    foreign = clashing.limit(1).withColumn("text", F.lit("\u0433\u0434\u0435 " * 80)).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.languages(spark, clashing.unionByName(foreign), SF)
    assert got.columns == clashing.columns
    assert key(got) == own([r for r in every if any(c.isalpha() for c in r["text"] or "")])

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {w for r in bench if r["text"] for w in decontaminate.windows(decontaminate.words_of(r["text"].encode()))}
    sizes = sorted({len(w) for w in windows})

    def hits(text):
        words = decontaminate.words_of((text or "").encode())
        hit = {i + k for n in sizes for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for k in range(n)}
        return len(hit) > 0 and 20 * len(hit) >= len(words)

    got = corpus_pipeline.decontaminated(spark, clashing, SF)
    assert got.columns == clashing.columns and key(got) == own([r for r in every if not hits(r["text"])])

    rows = clashing.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    prints = {r["doc_id"]: simhash_dedup.fingerprint((r["text"] or "").encode()) for r in rows.collect()}
    near = {a: min(b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2) for a in prints}
    while (again := {a: near[b] for a, b in near.items()}) != near:
        near = again
    got = corpus_pipeline.near_duplicates(spark, rows, SF)
    assert got.columns == rows.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(a for a in near if near[a] == a)

    got = corpus_pipeline.mixed(spark, clashing, SF)
    assert got.columns == clashing.columns
    left = key(got)
    assert 0 < len(left) < len(every) and all(k in own(every) for k in left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.where("false"), SF).collect() == []


def test_held_out_rows_are_told_by_crc(spark, docs):
    got = {r["doc_id"]: r["held_out"] for r in quality_mil.op9_quality_mil(spark, SF).collect()}
    assert got == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs.collect()}
