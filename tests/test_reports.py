"""Fallbacks of feeds, hashtags at any depth, remote reports, pages read and reports as text, on small inputs."""

import json

from pyspark.sql import functions as F

from trendspark.operators import chat as C
from trendspark.operators import groups as G
from trendspark.operators import labels as V
from trendspark.operators import pages as P
from trendspark.operators import reports as R
from trendspark.sources import feeds
from trendspark.sources import store as S

LISTING, RSS = "feed string, place int, status int, payload string, run_ts timestamp", "feed string, payload string, run_ts timestamp"


def _at(df):
    return df.withColumn("run_ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def test_refused_listings_give_way(spark):
    posts = lambda *scores: json.dumps({"data": {"children": [{"data": {"title": f"P{n}", "score": n}} for n in scores]}})
    atom = lambda t: f"<feed><entry><title>{t}</title><link href='https://r/1'/></entry></feed>"
    asked = [("a", 0, 200, posts(5, 9), None), ("b", 1, 500, None, None), ("c", 2, 200, posts(7), None), ("d", 3, 429, None, None), ("e", 4, 200, posts(100), None), ("f", 5, 403, None, None)]
    rss = [(f, atom(f"R{f}"), None) for f in "abcde"]
    got = feeds.reddit_feeds(_at(spark.createDataFrame(asked, LISTING)), _at(spark.createDataFrame(rss, RSS)))
    assert [r.title for r in got.orderBy("nth").collect()] == ["P9", "P7", "P5", "Rb", "Rd", "Re"]
    assert feeds.reddit_feeds(spark.createDataFrame([], LISTING), spark.createDataFrame([], RSS)).count() == 0


def test_hashtags(spark):
    deep = {"a": [{"hashtag_name": "One", "video_views": "12"}, {"b": {"c": [{"hashtagName": "#two words", "rank": 7, "publishCnt": 0, "inner": {"hashtagName": "hidden"}}]}}], "z": [{"hashtagName": "ONE"}, {"hashtagName": "ad", "is_promoted": True}, {"hashtagName": None}, {"hashtagName": "x*~/", "videoViews": "many"}]}
    page = lambda text: f"<script id='__NEXT_DATA__'>{text}</script><b># Ünder</b><b>#a</b>"
    pages = [("p", page(json.dumps(deep))), ("q", page("{oops")), ("r", page("{}")), ("s", "<b>#tag one</b><b>#TAG ONE</b>"), ("t", None), ("u", "")]
    df = _at(spark.createDataFrame([(*p, None) for p in pages], "page string, payload string, run_ts timestamp"))
    got = sorted((r.title, r.raw_score, r.url.rsplit("tag/")[1], r.shown_rank) for r in feeds.tiktok_hashtags(df).collect())
    assert got == [("#One", 12.0, "One", 1), ("#tag one", 2.0, "tag%20one", 1), ("#two words", 5.0, "two%20words", 7), ("#x*~/", 1.0, "x%2A~/", 6), ("#Ünder", 1.0, "%C3%9Cnder", 1)]


def test_year_before(spark):
    table = lambda name: f"## Top AI Papers of the Week (December 25 - December 31)\n| 1) **{name}** - d | [Paper](https://arxiv.org/abs/2401.00001v1) |\n"
    rows = lambda *r: _at(spark.createDataFrame([(*x, None) for x in r], "year int, payload string, run_ts timestamp"))
    titles = lambda df: [r.title for r in feeds.papers_of_the_year(df).collect()]
    assert titles(rows((2024, table("New")), (2023, table("Old")), (2022, table("Gone")))) == ["New"]
    assert titles(rows((2024, "# nothing"), (2023, table("Old")))) == ["Old"] and titles(rows((2024, None), (2022, table("Gone")))) == []


def test_remote_reports(spark, tmp_path):
    schema, runs = "run_id string", lambda *r: spark.createDataFrame(r, "cloud_run string, created_at long, status string")
    for run, name, text in (("7", "report-1.json", '{"run_id": "old"}'), ("7", "report-2.json", '{"run_id":\n "new"}'), ("7", "other.json", '{"run_id": "no"}'), ("8", "report-1.json", "{oops")):
        (tmp_path / run / "part").mkdir(parents=True, exist_ok=True)
        (tmp_path / run / "part" / name).write_text(text)
    report = lambda *r: tuple(S.cloud_report(spark, runs(*r), str(tmp_path), schema).select("cloud_run", "report.run_id", "note").first())
    good = ("7", 70, "success")
    assert report(good, ("6", 60, "success"), ("9", 90, "failure")) == ("7", "new", None)
    assert report(good, ("8", 80, "success")) == ("8", None, "the report of run 8 can't be read")
    assert report(("5", 50, "success")) == ("5", None, "run 5 has no report") and report(("9", 90, "failure")) == (None, None, "no successful run") == report()


def test_pages_are_fetched_once(spark):
    urls = [(1, "H1", ["https://news.google.com/a", "u1", "u2", "u3"]), (2, "H2", ["u2", "u4"]), (3, "H3", []), (4, None, None)]
    wanted = P.deep_reads(spark.createDataFrame(urls, "rank int, headline string, source_urls array<string>"))
    cache = spark.createDataFrame([("u1", "said"), ("u4", ""), ("u9", "other")], "url string, text string")
    assert [tuple(r) for r in P.to_fetch(wanted, cache).collect()] == [("u2", "H1")]
    assert [tuple(r) for r in P.excerpts(wanted, cache).collect()] == [(1, 1, "u1", "said")]


def test_hints_count_twice(spark):
    rows = [(1, 0, {"Sports": 1, "Tech": 0}, "Tech"), (1, 1, {"Sports": 1, "Tech": 0}, None), (2, 0, {"Sports": 0, "Tech": 0}, None), (3, 0, {"Sports": 1, "Tech": 2}, None), (3, 1, {"Sports": 1, "Tech": 0}, None), (4, 0, {"Sports": 0, "Tech": 0}, "News")]
    voted = spark.createDataFrame(rows, "draft_id int, item_id int, votes map<string,int>, hint string")
    assert dict(V.draft_category(voted, F.col("item_id")).collect()) == {1: "Sports", 2: "News", 3: "Sports", 4: "News"}


def test_vectors_or_words(spark):
    vectors = spark.createDataFrame([("r", 1, [1.0, 0.0]), ("r", 2, [1.0, 0.01]), ("r", 3, [0.0, 1.0])], "run_id string, vec_id long, embedding array<double>")
    items = spark.createDataFrame([(1, "Harbour bridge opens"), (2, "Harbour bridge closes"), (3, "Rain")], "item_id long, title string")
    for got in (G.topic_groups(items, vectors, method="threshold"), G.topic_groups(items)):
        assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1)]


def test_empty_reports(spark):
    runs = spark.createDataFrame([("r", "local", 0.0, 1800.0, None, 3)], "run_id string, origin_label string, started_at double, now double, llm_mode string, ingested long")
    trend = "run_id string, rank int, category string, headline string, relevance int, velocity double, momentum string, windows array<struct<hours:double,growth:double>>, items int, sources array<string>, summary string, entities array<string>, source_urls array<string>"
    stat, was = "run_id string, place int, source string, ok boolean, item_count long, error string", "run_id string, started_at double, headlines array<string>"
    none = lambda s: spark.createDataFrame([], s)
    text = R.grounding(runs, none(trend), none(stat), none(was)).first().text
    assert text.split("\n") == ["REPORT: local, started 1970-01-01 00:00 UTC (0.5 hours ago), engine null, 3 items ingested, 0 trends.", "", "TRENDS (ranked):", R.NO_TRENDS]
    payload = json.loads(R.api_projection(runs, none(trend), none(stat)).first().payload)
    assert payload["trends"] == [] == payload["source_stats"] and payload["age_hours"] == 0.5 and payload["llm_mode"] is None
    odd = spark.createDataFrame([("r", 1, None, None, None, None, None, None, None, None, None, None, None)], trend)
    assert "#1 [" in R.grounding(runs, odd, none(stat), none(was)).first().text


def test_turns_of_a_chat(spark):
    said = [(1, 0, "user", "What of the bridge toll in York?"), (1, 1, "assistant", "It rose."), (1, 2, "user", "And #2, #9?"), (2, 0, "user", "Hello"), (2, 1, "assistant", "Hi."), (3, 0, "system", "x"), (3, 1, "user", "  "), (4, 0, "user", "bridge toll"), (5, 0, "user", "no such thing"), (5, 1, "assistant", None)]
    trends = [(1, "Bridge toll rises", ["York"], ["https://news.google.com/a", "https://a/1", "https://a/2", "https://a/3"]), (2, "Quake", ["Lima"], None)]
    args = (
        spark.createDataFrame(said, "conv_id long, turn int, role string, text string"), spark.createDataFrame(trends, "rank int, headline string, entities array<string>, source_urls array<string>"),
        spark.createDataFrame([("https://a/1", "The toll rose."), ("https://a/9", "other")], "url string, text string"), spark.createDataFrame([("REPORT",)], "text string"),
    )
    got = {r["conv_id"]: r for r in C.turns(*args, rules="RULES").collect()}
    assert {k: (r["outcome"], r["question"], r["ranks"], r["to_read"]) for k, r in got.items()} == {
        1: ("ask", "And #2, #9?", [2], []), 2: ("no question", None, None, None), 4: ("ask", "bridge toll", [1], ["https://a/2"]), 5: ("ask", "no such thing", [], []),
    }
    assert got[4]["told"] == "RULES\n\nREPORT\n\nEXCERPTS:\n[#1] https://a/1\nThe toll rose." and got[5]["told"] == "RULES\n\nREPORT"
    assert [tuple(m) for m in got[1]["messages"]] == [("user", "What of the bridge toll in York?"), ("assistant", "It rose."), ("user", "And #2, #9?")]
    assert C.turns(args[0].where("false"), *args[1:]).collect() == []
