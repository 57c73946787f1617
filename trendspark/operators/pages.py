"""Context from pages: public addresses, what a page says, and where each item has its context from. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.functions import normalize as N
from trendspark.functions import prose as P

LIMIT, LEAST_LETTERS, READ, SHOWN = 600, 40, 4, 2

# Parts of a page without prose, and addresses that are not public.
NO_PROSE = ["script", "style", "nav", "header", "footer", "aside", "form", "noscript"]
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
PRIVATE_IPV4 = r"^(?:0|10|127|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
PRIVATE_IPV6 = r"^(?:::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:db8:)"
HOST = r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^:/?#]*)"


def is_public_url(url: Column) -> Column:
    """Whether an address is http(s) with a host that is neither local nor a private, loopback, link-local or reserved IP."""
    host = F.btrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("[]"))
    local = (host == "localhost") | host.rlike(r"\.(?:local|internal)$")
    private = (host.rlike(IPV4) & host.rlike(PRIVATE_IPV4)) | (F.contains(host, F.lit(":")) & host.rlike(PRIVATE_IPV6))
    return (host != "") & ~local & ~private


def _meta(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, rf"(?is)(<meta\s[^>]*(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*>)", 1)
    return F.nullif(F.regexp_extract(tag, r"(?is)\scontent\s*=\s*\"([^\"]*)\"", 1), F.lit(""))


def page_context(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with page_title, meta and paragraphs: what a page is called, says of itself and says first.

    The title is og:title, else the title element; meta the first of the og, plain and twitter descriptions. A paragraph runs
    from its tag to the next one or its end, in the article, else the main part, else the body; the first four of 60
    characters or more are read, and two of those that aren't boilerplate kept. Null pages say nothing.
    """
    page = F.coalesce(html, F.lit(""))
    title = F.coalesce(_meta(page, "og:title"), F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))
    meta = F.coalesce(*[_meta(page, n) for n in ("og:description", "description", "twitter:description")], F.lit(""))
    body = F.regexp_replace(page, r"(?s)<!--.*?-->", " ")
    for tag in NO_PROSE:
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    pages = pages.withColumn("_body", body)
    part = lambda tag: F.nullif(F.regexp_extract("_body", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))
    pages = pages.withColumn("_body", F.coalesce(part("article"), part("main"), part("body"), "_body"))
    said = F.slice(F.split("_body", r"(?i)<p(?:\s[^>]*)?>"), F.lit(2), F.lit(1 << 30))
    said = F.transform(said, lambda p: N.normalize_text(F.regexp_replace(F.get(F.split(p, "(?i)</p>"), F.lit(0)), "<[^>]*>", " ")))
    read = F.slice(F.filter(said, lambda p: F.length(p) >= L.MIN_PARAGRAPH), 1, READ)
    kept = F.slice(F.filter(read, lambda p: ~F.substring(p, 1, 160).rlike("(?i)" + L.BOILERPLATE)), 1, SHOWN)
    return pages.select("*", N.normalize_text(title).alias("page_title"), N.normalize_text(F.when(meta.rlike("(?i)" + L.BOILERPLATE), "").otherwise(meta)).alias("meta"), kept.alias("paragraphs")).drop("_body")


def build_context(title: Column, meta: Column, paragraphs: Column, item_title: Column, limit: int = LIMIT) -> Column:
    """Title, meta and paragraphs in one text, without what is empty, said before or a short echo of the item's title.

    Null if fewer than 40 letters are left.
    """
    parts = F.transform(F.concat(F.array(title, meta), paragraphs), lambda p: F.trim(F.coalesce(p, F.lit(""))))
    echo = lambda p: (F.substring(F.lower(p), 1, 60) == F.substring(F.lower(item_title), 1, 60)) & (F.length(p) < 120)
    said = lambda seen, p: F.exists(seen, lambda s: F.contains(F.substring(F.lower(s), 1, 80), F.substring(F.lower(p), 1, 50)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda seen, p: F.when((p == "") | echo(p) | said(seen, p), seen).otherwise(F.concat(seen, F.array(p))))
    text = P.clip(F.array_join(kept, " | "), limit)
    return F.when(F.length(F.regexp_replace(text, "[^A-Za-z]", "")) >= LEAST_LETTERS, text)


def route(items: DataFrame) -> DataFrame:
    """items (source, url, description, external_url, news_urls, news_titles) with the address whose page is wanted and what the
    feed itself has to say, in `page_url` and `feed_context`."""
    source, description = F.col("source"), F.coalesce("description", F.lit(""))
    no_page = source.isin(*L.NO_PAGE_SOURCES, *L.FEED_CONTEXT_SOURCES, "wikipedia") | ((source == "reddit") & (F.length(description) >= L.MIN_PARAGRAPH))
    url = F.when(source == "reddit", F.nullif("external_url", F.lit(""))).when(source == "google_trends", F.get("news_urls", F.lit(0))).when((source == "hackernews") & F.contains("url", F.lit("news.ycombinator.com/item")), F.lit(None).cast("string")).otherwise(F.col("url"))
    news = F.nullif(F.array_join(F.slice("news_titles", 1, 3), " | "), F.lit(""))
    feed = F.when(source.isin(*L.NO_PAGE_SOURCES, "wikipedia"), None).when(source.isin(*L.FEED_CONTEXT_SOURCES), F.nullif(description, F.lit("")))
    feed = feed.when((source == "google_trends") & news.isNotNull(), news).when(F.length(description) >= 30, description)
    return items.withColumn("page_url", F.when(~no_page, url)).withColumn("feed_context", feed)


def enrich(items: DataFrame, pages: DataFrame, articles: DataFrame, limit: int = LIMIT) -> DataFrame:
    """items of `route` with context, context_source and outcome. pages (url, html) have been fetched, one row an address;
    articles (title, extract, description) are summaries of encyclopedia articles.

    A page that wasn't fetched or says too little leaves the feed's own words. Only addresses that items want are read.
    """
    wanted = items.where(is_public_url(F.col("page_url"))).select(F.col("page_url").alias("url")).distinct()
    said = page_context(pages.join(wanted, "url", "left_semi")).select(F.col("url").alias("page_url"), "page_title", "meta", "paragraphs")
    known = articles.select(F.lit("wikipedia").alias("source"), "title", F.col("extract").alias("_extract"), F.col("description").alias("_about"), F.lit(True).alias("_found"))
    out = items.join(said, "page_url", "left").join(known, ["source", "title"], "left")
    nothing = F.array().cast("array<string>")
    page = build_context(F.col("page_title"), F.col("meta"), F.coalesce("paragraphs", nothing), F.col("title"), limit)
    article = F.when(F.col("_found"), build_context(F.lit(""), F.col("_about"), F.array("_extract"), F.col("title"), limit))
    out = out.withColumn("_page", page).withColumn("_article", article).withColumn("_feed", P.clip(F.col("feed_context"), limit))
    source = F.col("source")
    no_feed = F.when(source == "wikipedia", F.when(F.col("_found"), "no_context").otherwise("fetch_failed")).when(source.isin(*L.FEED_CONTEXT_SOURCES), "no_context").when(F.coalesce("page_url", F.lit("")) != "", "fetch_failed").otherwise("no_url")
    outcome = F.when(source.isin(*L.NO_PAGE_SOURCES), "no_page").when(F.col("_article").isNotNull(), "wikipedia_api").when(F.col("_page").isNotNull(), "page").when(F.col("feed_context").isNotNull(), "feed").otherwise(no_feed)
    out = out.withColumn("outcome", outcome)
    context = F.when(F.col("outcome") == "wikipedia_api", F.col("_article")).when(F.col("outcome") == "page", F.col("_page")).when(F.col("outcome") == "feed", F.col("_feed"))
    return out.withColumn("context", context).withColumn("context_source", F.when(context.isNotNull(), F.col("outcome"))).drop("_page", "_article", "_feed", "_extract", "_about", "_found", "page_title", "meta", "paragraphs")


def outcomes(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("outcome").agg(F.count("*").alias("items"), F.count("context").alias("with_context"))


def deep_reads(trends: DataFrame, limit: int = SHOWN) -> DataFrame:
    """(rank, nth, url, headline): the first addresses of each trend (rank, headline, source_urls) that lead to a page of its own."""
    urls = F.slice(F.filter("source_urls", lambda u: ~F.contains(u, F.lit(L.REDIRECTS))), 1, limit)
    return trends.select("rank", "headline", F.posexplode(urls).alias("nth", "url")).select("rank", (F.col("nth") + 1).alias("nth"), "url", "headline")


def to_fetch(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(url, headline) of wanted addresses that the cache (url, text) lacks, each once, with the headline that asks first."""
    missing = wanted.join(cache.select("url"), "url", "left_anti")
    return missing.groupBy("url").agg(F.min_by("headline", F.struct("rank", "nth")).alias("headline"))


def excerpts(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(rank, nth, url, text) of wanted addresses whose page says something."""
    return wanted.join(cache.where("text <> ''").select("url", "text"), "url").select("rank", "nth", "url", "text")
