"""Pages, addresses and the choice of context on small inputs."""

from pyspark.sql import functions as F

from trendspark.operators import pages as G

LONG = "The council voted on Monday to rebuild the old harbour bridge after years of talks."
OTHER = "Work starts in spring and is to take three years, the mayor told the local paper."


def test_addresses(spark):
    urls = {"https://a.org/x": True, "http://user@a.org:80/": True, "ftp://a.org": False, "http://localhost/": False, "https://x.local": False, "http://10.1.2.3/": False, "http://172.20.0.1": False, "http://172.40.0.1": True, "http://192.168.0.9": False, "http://8.8.8.8/": True, "http://[::1]/": False, "http://[fe80::1]/": False, "http://[2a00:1450::1]/": True, "http:///x": False, "": False}
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None])], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(G.is_public_url(F.col("u"))).collect()] == [*urls.values(), False]


def test_pages(spark):
    html = f'<html><head><title>T &amp; U</title><meta property="og:title" content="Bridge news"><meta name="description" content="About the bridge"></head><body><p>{OTHER}</p><article><nav><p>{LONG}</p></nav><p class=x>Short.</p><p>Subscribe to our newsletter to read this story and many others like it.</p><p>{LONG}<p><b>{OTHER}</b></article></body></html>'
    df = spark.createDataFrame([(1, html), (2, "<title>Only</title>"), (3, None), (4, "")], "i int, html string")
    got = {r.i: (r.page_title, r.meta, r.paragraphs) for r in G.page_context(df).collect()}
    assert got == {1: ("Bridge news", "About the bridge", [LONG, OTHER]), 2: ("Only", "", []), 3: ("", "", []), 4: ("", "", [])}


def test_contexts(spark):
    made = lambda t, m, p, title: spark.range(1).select(G.build_context(F.lit(t), F.lit(m), F.array(*map(F.lit, p)) if p else F.array().cast("array<string>"), F.lit(title))).first()[0]
    assert made("Bridge news", LONG[:60], [LONG, OTHER], "Bridge news") == f"{LONG[:60].strip()} | {OTHER}"
    assert made("Bridge news", "", [], "x") is None and made("", "", [], "") is None


def test_routes(spark):
    rows = [
        ("tiktok", "T", "https://a.org/1", LONG, None, None, None, "no_page"), ("arxiv", "T", "https://a.org/1", LONG, None, None, None, "feed"), ("arxiv", "T", None, None, None, None, None, "no_context"),
        ("wikipedia", "Bridge", None, None, None, None, None, "wikipedia_api"), ("wikipedia", "Other", None, LONG, None, None, None, "fetch_failed"), ("wikipedia", "Stub", None, LONG, None, None, None, "no_context"),
        ("reddit", "T", "https://r/1", LONG, "https://a.org/1", None, None, "feed"), ("reddit", "T", "https://r/1", "short", "https://a.org/1", None, None, "page"), ("reddit", "T", "https://r/1", None, None, None, None, "no_url"),
        ("google_trends", "T", "https://s", None, None, ["https://gone"], ["N1", "N2"], "feed"), ("hackernews", "T", "https://news.ycombinator.com/item?id=1", None, None, None, None, "no_url"),
        ("hackernews", "T", "https://gone", None, None, None, None, "fetch_failed"), ("github", "T", "http://10.0.0.1", None, None, None, None, "fetch_failed"), ("github", "T", "https://a.org/1", None, None, None, None, "page"),
    ]
    schema = "item_id int, source string, title string, url string, description string, external_url string, news_urls array<string>, news_titles array<string>, want string"
    items = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    pages = spark.createDataFrame([("https://a.org/1", f"<title>Bridge</title><p>{LONG}</p>"), ("http://10.0.0.1", f"<p>{LONG}</p>")], "url string, html string")
    articles = spark.createDataFrame([("Bridge", LONG, "A bridge"), ("Stub", "tiny", None)], "title string, extract string, description string")
    out = G.enrich(G.route(items), pages, articles).orderBy("item_id").collect()
    assert [r.outcome for r in out] == [r[-1] for r in rows]
    assert all((r.context is None) == (r.outcome in ("no_page", "no_context", "no_url", "fetch_failed")) for r in out)
    assert {r.outcome: r.with_context for r in G.outcomes(G.enrich(G.route(items), pages, articles)).collect()}["page"] == 2
