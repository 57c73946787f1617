"""Decoders on small payloads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trendspark.functions import normalize as N
from trendspark.sources import feeds, ingest

NOW = dt.datetime(2026, 9, 25, 12)


@pytest.fixture
def payload(spark):
    def make(*texts, **more):
        rows = [(t, NOW, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, ["payload", "run_ts", *more])

    return make


def found(df, *columns):
    return [tuple(r) for r in df.orderBy("rank").select(*columns).collect()]


def test_hits_of_two_queries_count_once(payload):
    hit = lambda i, title, points: {"objectID": i, "title": title, "points": points, "num_comments": 3, "created_at_i": 86_400}
    df = payload(json.dumps({"hits": [hit("1", "A", 5), hit("2", "", 4)]}), json.dumps({"hits": [hit("1", "late", 9), hit("3", "C", 7)]}), "no json", query_no=[0, 1, 2])
    assert found(feeds.hacker_news(df), "title", "raw_score", "url", "ts") == [("A", 5.0, "https://news.ycombinator.com/item?id=1", dt.datetime(1970, 1, 2)), ("C", 7.0, "https://news.ycombinator.com/item?id=3", dt.datetime(1970, 1, 2))]


def test_articles_that_are_no_topics_go(payload):
    df = payload(json.dumps({"items": [{"articles": [{"article": a, "views": v} for a, v in [("Main_Page", 9), ("Jordan_Love", 3), ("2026", 2), ("Café", 1)]]}]}), day=["2026-09-24"])
    assert found(feeds.wikipedia_top(df), "title", "raw_score", "url", "ts") == [("Jordan Love", 3.0, "https://en.wikipedia.org/wiki/Jordan_Love", dt.datetime(2026, 9, 24, 23, 59)), ("Café", 1.0, "https://en.wikipedia.org/wiki/Caf%C3%A9", dt.datetime(2026, 9, 24, 23, 59))]


def test_listing_in_both_forms(payload):
    posts = [{"data": {"title": "sticky", "stickied": True}}, {"data": {"title": "kept", "score": 4, "num_comments": 2, "permalink": "/r/x/1", "selftext": "s" * 600}}, {"data": {"title": "second"}}]
    (row,) = feeds.reddit_listing(payload(json.dumps({"data": {"children": posts}}), feed=["x"]), limit=1).collect()
    assert (row.title, row.raw_score, row.url, len(row.description), row.subreddit, row.ts) == ("kept", 4.0, "https://www.reddit.com/r/x/1", 500, "x", NOW)
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://r/1"/><category term="news"/></entry></feed>'
    assert found(feeds.reddit_rss(payload(atom, feed=["x"])), "title", "raw_score", "url", "subreddit", "metrics_verified") == [("T", None, "https://r/1", "news", False)]


def test_a_feed_comes_again_in_a_later_run(spark):
    post = lambda t: json.dumps({"data": {"children": [{"data": {"title": t, "score": 5}}]}})
    later = NOW + dt.timedelta(hours=1)
    listings = [("news", 0, 200, post("first"), NOW), ("news", 0, 200, post("second"), later), ("tech", 1, 429, "", later)]
    atom = "<feed><entry><title>from rss</title></entry></feed>"
    rss = spark.createDataFrame([("tech", atom, NOW), ("tech", atom, later)], "feed string, payload string, run_ts timestamp")
    frame = spark.createDataFrame(listings, "feed string, place int, status int, payload string, run_ts timestamp")
    got = feeds.reddit_feeds(frame, rss)
    assert "_run" not in got.columns
    assert sorted(found(got, "title", "feed", "nth")) == [("first", "news", 1), ("from rss", "tech", 2), ("second", "news", 1)]


def test_trends_and_news(payload):
    trends = '<rss xmlns:ht="x"><channel><item><title>packers</title><ht:approx_traffic>500K+</ht:approx_traffic><ht:news_item><ht:news_item_title>Win</ht:news_item_title><ht:news_item_url>https://n/1</ht:news_item_url></ht:news_item></item><item><title>a b</title></item></channel></rss>'
    assert found(feeds.google_trends(payload(trends)), "title", "raw_score", "url", "description") == [("packers", 500000.0, "https://n/1", "Win"), ("a b", None, "https://www.google.com/search?q=a+b", None)]
    news = '<rss><channel><item><title>Bill - x - Pub</title><link>https://n/2</link><source url="u">Pub</source><pubDate>Thu, 24 Sep 2026 10:00:00 GMT</pubDate></item><item><title>Museum - Other</title><link>https://n/3</link></item></channel></rss>'
    assert found(feeds.google_news(payload(news)), "title", "raw_score", "ts") == [("Bill - x", 2.0, dt.datetime(2026, 9, 24, 10)), ("Museum", 1.0, NOW)]


def test_papers(payload):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>Long\n  title</title><summary>S</summary><published>2026-09-24T00:00:00Z</published><author><name>A</name></author></entry></feed>'
    assert found(feeds.arxiv(payload(atom)), "title", "url", "authors", "ts") == [("Long title", "http://arxiv.org/abs/1", ["A"], dt.datetime(2026, 9, 24))]
    week = lambda label, rows: f"## Top AI Papers of the Week ({label}) - 2026\n| **Paper** | **Links** |\n| --- | --- |\n" + "".join(f"| {i + 1}) **{n}** - About <br>more | {link} |\n" for i, (n, link) in enumerate(rows))
    text = "# Title\n\n" + week("September 14 - September 20", [("One", "[Paper](https://a.org/slug-2609.00001), [Tweet](https://x)"), ("Two", "[Paper](https://b)")]) + "\n---\n\n" + week("September 7 - September 13", [("Old", "[Paper](https://c)")])
    assert found(feeds.weekly_papers(payload(text, year=[2026])), "title", "raw_score", "url", "description", "ts") == [("One", 2.0, "https://arxiv.org/abs/2609.00001", "About", dt.datetime(2026, 9, 20)), ("Two", 1.0, "https://b", "About", dt.datetime(2026, 9, 20))]


def test_pages_of_trends(payload):
    page = '<ol class="trend-card__list"><li><a class="trend-link" href="#">#One &amp; only</a><span class="tweet-count" data-count="12K">12K</span></li><li>no link</li><li><a href="#">Two</a></li></ol><ol class="trend-card__list"><li><a>Late</a></li></ol>'
    assert found(feeds.x_trends(payload(page)), "title", "raw_score", "rank") == [("#One & only", 12000.0, 1), ("Two", 1.0, 2)]
    links = '<a href="https://x.com/search?q=a">Alpha</a><a href="https://twitter.com/search?q=a">ALPHA</a><a href="https://x.com/search?q=b">Be ta</a><a href="https://z.org">No</a>'
    assert found(feeds.x_trends(payload(links)), "title", "raw_score", "url") == [("Alpha", 2.0, "https://x.com/search?q=Alpha"), ("Be ta", 1.0, "https://x.com/search?q=Be%20ta")]
    assert feeds.x_trends(payload("nothing", None)).collect() == []


def test_repositories_and_products(payload):
    page = '<article class="Box-row"><h2><a href="/a/b-c">x</a></h2><p> Makes <b>tea</b></p><span itemprop="programmingLanguage">Rust</span><span>1.2k stars today</span></article><article class="Box-row"><h2><a href="/a/d_e">x</a></h2></article>'
    assert found(feeds.github_trending(payload(page)), "title", "raw_score", "url", "language") == [("a/b-c: Makes tea", 1200.0, "https://github.com/a/b-c", "Rust"), ("a/d_e (d e)", 0.0, "https://github.com/a/d_e", None)]
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Cup</title><link href="https://p/1"/><content type="html">&lt;p&gt;Holds tea&lt;/p&gt; Discussion | Link</content></entry><entry><title>Bare</title><link href="https://p/2"/></entry></feed>'
    assert found(feeds.product_hunt(payload(feed)), "title", "raw_score", "url", "description") == [("Cup: Holds tea", 2.0, "https://p/1", "Holds tea"), ("Bare", 1.0, "https://p/2", None)]


def test_sources_come_together(payload):
    news = feeds.google_news(payload("<rss><channel><item><title>N</title></item></channel></rss>"))
    posts = feeds.reddit_listing(payload(json.dumps({"data": {"children": [{"data": {"title": "P"}}]}}), None, feed=["x", "y"]))
    got = feeds.all_items([news, posts])
    assert got.columns == feeds.ITEM and sorted(r.title for r in got.collect()) == ["N", "P"]


def test_normal_forms(spark):
    df = spark.createDataFrame([(" – Café &amp; bar!!!! https://a.b/c x… ", "#JordanLove", "#GBvsATL", "Thu, 24 Sep 2026 10:00:00 +0000", ["1", "#2", "x"], "7.5")], ["t", "h", "g", "d", "i", "r"])
    got = df.select(N.normalize_text(F.col("t")), N.split_hashtag(F.col("h")), N.split_hashtag(F.col("g")), N.parse_datetime(F.col("d"), F.lit(NOW)), N.coerce_ids(F.col("i")), N.relevance(F.col("r")), N.relevance(F.lit("much"))).first()
    assert tuple(got) == ("Cafe & bar! x.", "Jordan Love", "GB vs ATL", dt.datetime(2026, 9, 24, 10), [1, 2], 8, 5)


PAYLOADS = "run_id long, source string, place int, part string, form string, status int, error string, payload string, run_ts timestamp"


def test_sources_that_fail_have_a_row_of_their_own(spark):
    news = lambda t: f"<?xml version='1.0'?><rss><channel><item><title>{t}</title></item></channel></rss>"
    hits = lambda *ks: json.dumps({"hits": [{"objectID": k, "title": f"story {k}", "points": 1} for k in ks]})
    post = json.dumps({"data": {"children": [{"data": {"title": "post", "score": 3}}]}})
    later = NOW + dt.timedelta(hours=1)
    rows = [
        (1, "google_news", 0, None, None, 200, None, news("a"), NOW), (1, "google_news", 1, None, None, 200, None, "<rss><channel>", NOW), (2, "google_news", 0, None, None, 200, None, news("b"), later),
        (1, "hackernews", 0, "0", None, 200, None, "nothing", NOW), (1, "hackernews", 1, "1", None, 200, None, hits("x", "y", "z"), NOW), (2, "hackernews", 0, "0", None, 503, None, hits("x"), later), (2, "hackernews", 1, "1", None, 200, "timed out", None, later),
        (1, "wikipedia", 0, "2024-01-02", None, 404, None, None, NOW), (1, "wikipedia", 1, "2024-01-01", None, 200, None, '{"items": []}', NOW), (1, "github", 0, None, None, 200, None, "<html></html>", NOW),
        (1, "reddit", 0, "news", "json", 429, None, "", NOW), (1, "reddit", 0, "news", "rss", 200, None, "<feed><entry><title>from rss</title></entry></feed>", NOW), (2, "reddit", 0, "news", "json", 200, None, post, later),
        (1, "other", 0, None, None, 200, None, "x", NOW),
    ]
    df = spark.createDataFrame(rows, PAYLOADS)
    items, stats = ingest.ingest(df, cap=2)
    assert {(r["run_id"], r["source"]): (r["ok"], r["item_count"], r["error"]) for r in stats.collect()} == {
        (1, "google_news"): (False, 0, "invalid XML"), (2, "google_news"): (True, 1, None), (1, "hackernews"): (True, 2, None), (2, "hackernews"): (False, 0, "0: HTTP 503; 1: timed out"), (1, "wikipedia"): (True, 0, None),
        (1, "github"): (False, 0, "no items"), (1, "reddit"): (True, 1, None), (2, "reddit"): (True, 1, None),
    }
    got = [(r["run_id"], r["source"], r["title"]) for r in items.orderBy("run_id", "source_no", "nth").collect()]
    assert got == [(1, "reddit", "from rss"), (1, "hackernews", "story x"), (1, "hackernews", "story y"), (2, "reddit", "post"), (2, "google_news", "b")]
    assert [r["source"] for r in ingest.ingest(df, ["github"])[1].collect()] == ["github"]
    with pytest.raises(ValueError, match="nobody"):
        ingest.ingest(df, ["nobody"])
    nothing = ingest.ingest(df.where("false"))
    assert nothing[0].collect() == nothing[1].collect() == []


def test_all_items_count_without_a_cap(spark):
    """The query of statistics had a cap of 1,000,000 items, which large tables exceed."""
    hits = json.dumps({"hits": [{"objectID": str(k), "title": f"story {k}", "points": 1} for k in range(3 * ingest.CAP)]})
    df = spark.createDataFrame([(1, "hackernews", 0, "0", None, 200, None, hits, NOW)], PAYLOADS)
    items, stats = ingest.ingest(df, ["hackernews"], None)
    assert [r["item_count"] for r in stats.collect()] == [items.count()] == [3 * ingest.CAP]
    assert [r["item_count"] for r in ingest.ingest(df, ["hackernews"])[1].collect()] == [ingest.CAP]
