"""Run history written, read, purged and reported."""

import html
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trendspark.functions import plain
from trendspark.sources import snapshots as Q
from trendspark.sources import store as S

DAY = 86_400.0


def save(spark, path, n, finished=True):
    run = spark.createDataFrame([(f"r{n}", n * DAY, n * DAY + 9 if finished else None, 3, 2, 9, "none", 9.0)], S.RUN)
    items = spark.createDataFrame([(f"r{n}", f"t{i}", i < 2, 2 - i) for i in range(3)], "run_id string, text_key string, kept boolean, duplicate_count int")
    clusters = spark.createDataFrame([(f"r{n}", f"c{i}", f"h{n}.{i}", float(i)) for i in range(9)], "run_id string, cluster_id string, headline string, combined_score double")
    S.save_run(path, run, items, clusters)


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    for n in range(1, 9):
        save(spark, path, n, finished=n < 8)
    got = S.load_local(spark, path).orderBy("nth").collect()
    assert [r.run_id for r in got] == ["r7", "r6", "r5", "r4", "r3", "r2"]
    assert got[0].headlines == [f"h7.{i}" for i in range(8, 0, -1)]
    one = S.finished_runs(spark, path).where("run_id = 'r3'")
    assert sorted(map(tuple, S.kept_titles(S.of_runs(spark, path, "items", one)).collect())) == [("r3", "t0", 2), ("r3", "t1", 1)]
    to = str(tmp_path / "kept")
    S.purge(spark, path, to, 6 * DAY)
    assert [r.run_id for r in S.load_local(spark, to).orderBy("nth").collect()] == ["r7", "r6"]
    assert spark.read.parquet(f"{to}/items").select("run_id").distinct().count() == 3


def test_rows_that_cannot_be_read_go(spark):
    rows = [("a", "h", '["x"]', None, "[]", None, None), ("b", "h", "{oops", "[]", "[]", "NEW", "history"), ("c", "", "[]", "[]", "[]", "NEW", "history")]
    df = spark.createDataFrame(rows, "cluster_id string, headline string, entities string, source_urls string, sources string, momentum string, velocity_basis string")
    assert [(r.cluster_id, r.entities, r.source_urls, r.momentum, r.velocity_basis) for r in S.readable_clusters(df).collect()] == [("a", ["x"], [], "STEADY", "cold_start")]


def test_ages_and_report(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 7200.0), (9.0, 3.0)], "a double, b double").withColumn("age", S.age_hours(F.col("a"), F.col("b")))
    assert [r.age for r in df.collect()] == [2.0, 0.0]
    S.write_report(spark.createDataFrame([(1, None)], "rank int, headline string"), str(tmp_path / "report"))
    (text,) = [p.read_text() for p in (tmp_path / "report").glob("*.json") if p.stat().st_size]
    assert json.loads(text) == {"rank": 1, "headline": None}


def test_snapshots_keep_one_row_and_the_first_label(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    frame = lambda *rows: spark.createDataFrame(rows, Q.ROWS)
    key = lambda r: (r["run_id"], r["entity_key"])
    said = lambda: {key(r): (r["entity_label"], r["frequency"], r["rate"], r["captured_at"]) for r in Q.read(spark, path).collect()}
    assert said() == {} and Q.compact(spark, path, "1970-01-02") == 0
    Q.save(path, frame(("r1", "york", "York", 3, 1.5, DAY), ("r1", "rain", "Rain", 1, 0.5, DAY), ("r2", "york", "York", 9, 9.0, 2 * DAY)))
    Q.save(path, frame(("r1", "york", "YORK", 2, 2.5, DAY + 60)), 1)
    Q.save(path, frame(("r1", "york", "YORK", 2, 2.5, DAY + 60)), 1)
    want = {("r1", "york"): ("York", 3, 2.5, DAY), ("r1", "rain"): ("Rain", 1, 0.5, DAY), ("r2", "york"): ("York", 9, 9.0, 2 * DAY)}
    assert said() == want
    assert Q.compact(spark, path, "1970-01-02") == 3 and said() == want
    assert Q.compact(spark, path, "1970-01-02") == 0 and Q.compact(spark, path, "1970-01-03") == 0
    Q.save(path, frame(("r1", "rain", "rain", 7, 0.1, 2 * DAY)), 2)  # late, in another day
    assert said() == want | {("r1", "rain"): ("Rain", 7, 0.5, DAY)}
    assert Q.compact(spark, path, "1970-01-03") == 2
    assert said() == want | {("r1", "rain"): ("Rain", 7, 0.5, DAY)}


def test_a_compaction_that_stops_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snapshots")
    for k in (1, 2):
        Q.save(path, spark.createDataFrame([("r1", "york", f"York {k}", k, float(k), DAY)], Q.ROWS), k)
    want = Q.read(spark, path).collect()

    def stop(*_):
        raise OSError

    monkeypatch.setattr(Q, "_commit", stop)
    with pytest.raises(OSError):
        Q.compact(spark, path, "1970-01-02")
    assert Q.read(spark, path).collect() == want and want[0]["entity_label"] == "York 1" and want[0]["frequency"] == 2


def test_snapshot_of_a_run_takes_the_first_of_equals(spark):
    rows = [("r", "york", 2, "YORK", 5, 1.23456), ("r", "york", 1, "York", 5, 9.0), ("r", "york", 3, "york", 4, 1.0), ("r", "none", 1, "None", 0, 0.0), ("r", "", 1, "", 3, 1.0), ("q", "york", 1, "york", 1, 0.00004)]
    df = spark.createDataFrame(rows, "run_id string, entity_key string, ord int, label string, freq long, rate double")
    assert sorted(map(tuple, Q.of_run(df).collect())) == [("q", "york", "york", 1, 0.0), ("r", "york", "York", 5, 9.0)]


def test_plain_texts(spark):
    texts = ["&eacute;&#8217;&amp;amp; &notanentity; &#0; &#x110000;", "’‘“” – — …", "ﬁ ﬂ Ⅸ ½ ℌ ＦＵＬＬ", "日本 Ω ß æ ø", "a\tb\x00c\x7fd", "Wow!!!! No.... https://x.y/z?q=1 www.a.b end -|:", "&lt;b&gt; &copy &nbsp;x", "", None, " - ", "x" * 100_000]

    def want(t):
        t = html.unescape(t or "")
        for sign, say in (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), ("…", "...")):
            t = t.replace(sign, say)
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        t = re.sub(r"(?i)https?://\S+|www\.\S+", " ", t)
        t = re.sub(r"([!?.])\1{2,}", r"\1", "".join(c if c.isprintable() else " " for c in t))
        return re.sub(r"\s+", " ", t).strip(" -|:;,")

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", plain.normalized(F.col("t")).alias("n")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}
