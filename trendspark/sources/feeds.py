"""Decoders of feed payloads: one row of text for each response in, one row for each item out.

A payload is a column `payload`, the time of the run a column `run_ts`. What can't be parsed yields no item. Ranks are
places in the payload, and an item without a score of its own gets n - rank + 1, n the number of entries.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from trendspark.functions import normalize as N
from trendspark.functions import text as X

# Articles that are no topics, and patterns of the weekly tables.
NO_TOPIC = (
    r"(?i)^(Main_Page|Special:|Wikipedia:|File:|Portal:|Help:|Talk:|Category:|Template:|User:|Draft:|Module:|"
    r"Deaths_in_|List_of_|Search$|Undefined$|-$|\d{4}_in_|\d{4}$)"
)
WEEK_HEADING = r"(?m)^##\s+Top AI Papers of the Week\s*\(([^)]*)\)(?:\s*-\s*(\d{4}))?"
PAPER_ROW = r"(?m)^\|\s*(\d+)\)\s*\*\*(.+?)\*\*\s*[-:]?\s*(.*?)\s*\|\s*(.*?)\s*\|\s*$"
ARXIV_ID = r"(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?/?$"
HASHTAG_KEYS = ("hashtagName", "hashtag_name")
BLOCKED = (403, 429)

ITEM = ["source", "title", "raw_score", "comment_count", "url", "ts", "description", "rank"]
_LENIENT = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}
_LINKS = "array<struct<_VALUE:string,_href:string,_rel:string>>"


def _items(df: DataFrame, source: str, title: Column, score: Column, url: Column, ts: Column | None = None, comments: Column | None = None, description: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Rows that every decoder yields; blank titles go. A column `_run` of the payloads, which names their run, comes along."""
    nothing = F.lit(None)
    more = (more or {}) | ({"_run": F.col("_run")} if "_run" in df.columns else {})
    out = df.select(
        F.lit(source).alias("source"), F.trim(title).alias("title"), score.cast("double").alias("raw_score"), (nothing if comments is None else comments).cast("long").alias("comment_count"), url.alias("url"),
        (F.col("run_ts") if ts is None else F.coalesce(ts, F.col("run_ts"))).alias("ts"), (nothing if description is None else description).cast("string").alias("description"), F.col("rank").cast("int").alias("rank"),
        *[c.alias(k) for k, c in more.items()],
    )
    return out.where(F.length("title") > 0)


def _entries(df: DataFrame, column: Column) -> DataFrame:
    return df.withColumn("entries", column).select("*", F.posexplode("entries").alias("pos", "e")).withColumn("rank", F.col("pos") + 1).withColumn("n", F.size("entries")).drop("entries", "payload")


def _by_place() -> Column:
    return F.col("n") - F.col("rank") + 1


def hacker_news(df: DataFrame) -> DataFrame:
    """Hits of search responses (query_no, payload, run_ts): one row for each objectID of a run, of the first query that has it."""
    schema = "hits array<struct<objectID:string,title:string,story_title:string,url:string,points:double,num_comments:long,created_at_i:long>>"
    hits = _entries(df, F.from_json("payload", schema)["hits"]).where("e.objectID <> ''")
    first = hits.withColumn("nth", F.row_number().over(W.partitionBy("run_ts", "e.objectID").orderBy("query_no", "rank"))).where("nth = 1")
    e = lambda f: F.col(f"e.{f}")
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), e("objectID"))
    return _items(first, "hackernews", F.coalesce(F.nullif(e("title"), F.lit("")), e("story_title")), F.coalesce(e("points"), F.lit(0.0)), F.coalesce(F.nullif(e("url"), F.lit("")), page), F.timestamp_seconds(e("created_at_i")), F.coalesce(e("num_comments"), F.lit(0)))


def wikipedia_top(df: DataFrame, lang: str = "en", cap: int = 40) -> DataFrame:
    """The most viewed articles of a day (day, payload, run_ts), without pages that are no topics; cap of each day."""
    schema = "items array<struct<articles:array<struct<article:string,views:double,rank:int>>>>"
    seen = _entries(df, F.get(F.from_json("payload", schema)["items"], F.lit(0))["articles"])
    seen = seen.where((F.col("e.article") != "") & ~F.col("e.article").rlike(NO_TOPIC))
    seen = seen.withColumn("nth", F.row_number().over(W.partitionBy("run_ts", "day").orderBy("rank"))).where(F.col("nth") <= cap)
    closing = (F.col("day").cast("timestamp") + F.expr("INTERVAL '23:59' HOUR TO MINUTE"))
    url = F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), F.replace(F.url_encode("e.article"), F.lit("+"), F.lit("%20")))
    return _items(seen, "wikipedia", F.replace(F.col("e.article"), F.lit("_"), F.lit(" ")), F.coalesce("e.views", F.lit(0.0)), url, closing)


def reddit_listing(df: DataFrame, limit: int = 40) -> DataFrame:
    """Posts of listings (feed, payload, run_ts) but stickied, adult and promoted ones; the first `limit` of a feed in a run."""
    post = "struct<title:string,score:double,num_comments:long,permalink:string,created_utc:double,selftext:string,subreddit:string,stickied:boolean,over_18:boolean,promoted:boolean,is_self:boolean,url_overridden_by_dest:string>"
    posts = _entries(df, F.from_json("payload", f"data struct<children:array<struct<data:{post}>>>")["data"]["children"])
    d = lambda f: F.col(f"e.data.{f}")
    flag = lambda f: F.coalesce(d(f), F.lit(False))
    kept = posts.where(~flag("stickied") & ~flag("over_18") & ~flag("promoted") & (F.trim(d("title")) != ""))
    kept = kept.withColumn("nth", F.row_number().over(W.partitionBy("run_ts", "feed").orderBy("rank"))).where(F.col("nth") <= limit)
    when = F.when(d("created_utc") != 0, F.timestamp_seconds(d("created_utc")))
    more = {"subreddit": F.coalesce(d("subreddit"), F.col("feed")), "metrics_verified": F.lit(True), "external_url": d("url_overridden_by_dest"), "feed": F.col("feed")}
    return _items(kept, "reddit", d("title"), F.coalesce(d("score"), F.lit(0.0)), F.concat(F.lit("https://www.reddit.com"), F.coalesce(d("permalink"), F.lit(""))), when, F.coalesce(d("num_comments"), F.lit(0)), F.nullif(F.substring(d("selftext"), 1, 500), F.lit("")), more)


def reddit_rss(df: DataFrame) -> DataFrame:
    """Entries of the Atom form of a listing (feed, payload, run_ts): no score, metrics not verified."""
    seen = _entries(df, F.from_xml("payload", f"entry array<struct<title:string,link:{_LINKS},category:struct<_term:string>,updated:string>>", _LENIENT)["entry"])
    more = {"subreddit": F.coalesce("e.category._term", "feed"), "metrics_verified": F.lit(False), "external_url": F.lit(None).cast("string"), "feed": F.col("feed")}
    return _items(seen, "reddit", F.col("e.title"), F.lit(None), F.get(F.col("e.link"), F.lit(0))["_href"], N.parse_datetime(F.col("e.updated"), F.col("run_ts")), more=more)


def reddit_feeds(listings: DataFrame, rss: DataFrame, limit: int = 40, keep_run: bool = False) -> DataFrame:
    """Posts of the feeds of a run, with `nth`, their place: listings first, by score, then entries of the Atom form, by rank.

    listings has a row (feed, place, status, payload, run_ts) for each feed asked, rss a row (feed, payload, run_ts). A listing
    with a status other than 200 gives way to the Atom form of its feed; after one that was refused (403, 429) the listings
    of all later feeds do. A feed is one row of each, and a run has some tens of feeds.
    """
    refused = F.min(F.when(F.col("status").isin(*BLOCKED), F.col("place"))).over(W.partitionBy("run_ts"))
    asked = listings.withColumn("_open", (F.col("status") == 200) & F.coalesce(F.col("place") < refused, F.lit(True)))
    places = asked.select(F.col("run_ts").alias("_run"), "feed", F.col("place").alias("_place"), "_open")
    closed = places.where(~F.col("_open")).select(F.col("_run").alias("run_ts"), "feed")
    run = F.col("run_ts").alias("_run")
    posts = reddit_listing(asked.where("_open").select("feed", "payload", "run_ts", run), limit).withColumn("_rank", F.lit(999))
    entries = reddit_rss(rss.join(closed, ["run_ts", "feed"], "left_semi").select("feed", "payload", "run_ts", run)).where(F.col("rank") <= limit).withColumn("_rank", F.col("rank"))
    found = posts.unionByName(entries).join(places.drop("_open"), ["_run", "feed"])  # a feed comes again in every run
    best = W.partitionBy("_run").orderBy(F.desc("metrics_verified"), F.desc(F.coalesce("raw_score", F.lit(0.0))), "_rank", "_place", "rank")
    return found.withColumn("nth", F.row_number().over(best)).drop("_place", "_rank", *([] if keep_run else ["_run"]))


@F.pandas_udf(ArrayType(StringType()))
def _hashtag_records(text: pd.Series) -> pd.Series:
    """Objects that name a hashtag, at any depth of a JSON text and in its order; null where it can't be read."""

    def one(t: str | None) -> list[str] | None:
        try:
            left = [json.loads(t)] if t else []
        except ValueError:
            return None
        found = []
        while left:
            at = left.pop()
            if isinstance(at, dict) and any(k in at for k in HASHTAG_KEYS):
                found.append(json.dumps(at))
            elif isinstance(at, dict | list):
                left.extend(reversed(list(at.values()) if isinstance(at, dict) else at))
        return found

    return text.map(one)


def tiktok_hashtags(df: DataFrame) -> DataFrame:
    """Hashtags of pages (page, payload, run_ts) from the JSON that a page holds, else from texts that begin with `#`.

    Of names that differ in case only the first counts, on each page; promoted ones go. The score is the number of views,
    else of posts, else n - rank + 1. A page whose JSON can't be read yields nothing.
    """
    data = F.regexp_extract("payload", r"(?is)<script\b[^>]*\bid\s*=\s*[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    shown = F.regexp_extract_all("payload", F.lit(r"(?U)>(#\s?\w{2,}[^<]*)(?=<)"), F.lit(1))
    shown = F.transform(shown, lambda x: F.to_json(F.struct(F.btrim(x, F.lit("# \n\t")).alias("hashtagName"))))
    df = df.withColumn("_found", _hashtag_records(data))
    names = "hashtagName hashtag_name videoViews video_views publishCnt publish_cnt isPromoted is_promoted rank".split()
    schema = ", ".join(f"{n} string" for n in names) + ", industryInfo struct<value:string>, industry_info struct<value:string>"
    seen = _entries(df, F.when(F.size("_found") > 0, F.col("_found")).when(F.size("_found") == 0, shown)).drop("_found")
    seen = seen.withColumn("r", F.from_json("e", schema))
    said = lambda k: F.when(~F.col(f"r.{k}").isin("", "0", "0.0", "false"), F.col(f"r.{k}"))
    name = F.ltrim(F.trim(F.coalesce(*map(said, HASHTAG_KEYS))), F.lit("#"))
    first = W.partitionBy("run_ts", "page", F.lower("name")).orderBy("rank")
    kept = seen.withColumn("name", name).where("name <> ''").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    promoted = F.coalesce(said("isPromoted"), said("is_promoted")).isNotNull()
    views = F.coalesce(said("videoViews"), said("video_views"), said("publishCnt"), F.col("r.publish_cnt")).try_cast("double")
    url = F.url_encode("name")
    for sign, plain in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        url = F.replace(url, F.lit(sign), F.lit(plain))
    more = {"industry": F.coalesce("r.industryInfo.value", "r.industry_info.value"), "shown_rank": F.coalesce(F.col("r.rank").try_cast("int"), "rank")}
    return _items(kept.where(~promoted), "tiktok", F.concat(F.lit("#"), "name"), F.coalesce(views, _by_place()), F.concat(F.lit("https://www.tiktok.com/tag/"), url), more=more)


def google_trends(df: DataFrame) -> DataFrame:
    """Items of the trends feed: the traffic as score, up to three news titles as description, the first news link."""
    schema = "channel struct<item:array<struct<title:string,approx_traffic:string,pubDate:string,news_item:array<struct<news_item_title:string,news_item_url:string>>>>>"
    seen = _entries(df, F.from_xml("payload", schema, _LENIENT)["channel"]["item"])
    news = F.slice(F.coalesce("e.news_item", F.array().cast("array<struct<news_item_title:string,news_item_url:string>>")), 1, 3)
    search = F.concat(F.lit("https://www.google.com/search?q="), F.url_encode("e.title"))
    titles = F.nullif(F.array_join(F.transform(news, lambda x: x["news_item_title"]), " | "), F.lit(""))
    return _items(seen, "google_trends", F.col("e.title"), X.parse_count(F.col("e.approx_traffic")), F.coalesce(F.get(news, F.lit(0))["news_item_url"], search), N.parse_datetime(F.col("e.pubDate"), F.col("run_ts")), description=titles)


def google_news(df: DataFrame) -> DataFrame:
    """Items of the news feed, the publisher's name taken off the end of the title."""
    seen = _entries(df, F.from_xml("payload", "channel struct<item:array<struct<title:string,link:string,pubDate:string,source:struct<_VALUE:string,_url:string>>>>", _LENIENT)["channel"]["item"])
    tail = F.concat(F.lit(" - "), F.col("e.source._VALUE"))
    title = F.when(F.endswith("e.title", tail), F.substring(F.col("e.title"), F.lit(1), F.length("e.title") - F.length(tail))).otherwise(F.regexp_replace("e.title", r" - [^-]{2,60}$", ""))
    return _items(seen, "google_news", title, _by_place(), F.col("e.link"), N.parse_datetime(F.col("e.pubDate"), F.col("run_ts")))


def arxiv(df: DataFrame) -> DataFrame:
    """Entries of the Atom feed: spaces collapsed, the alternate link before the id, 500 characters of the summary."""
    seen = _entries(df, F.from_xml("payload", f"entry array<struct<id:string,title:string,summary:string,published:string,link:{_LINKS},author:array<struct<name:string>>>>", _LENIENT)["entry"])
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    page = F.get(F.filter("e.link", lambda x: x["_rel"] == "alternate"), F.lit(0))["_href"]
    more = {"authors": F.transform(F.slice("e.author", 1, 5), lambda a: a["name"])}
    return _items(seen, "arxiv", flat(F.col("e.title")), _by_place(), F.coalesce(page, F.trim("e.id")), N.parse_datetime(F.col("e.published"), F.col("run_ts")), description=F.substring(flat(F.col("e.summary")), 1, 500), more=more)


def weekly_papers(df: DataFrame) -> DataFrame:
    """Rows of the newest week in Markdown tables (year, payload, run_ts); links to arXiv papers in their short form."""
    return _weekly_papers(df).drop("year", "run_ts")


def papers_of_the_year(df: DataFrame) -> DataFrame:
    """Papers of weekly tables (year, payload, run_ts) of the year of the run, where that has none of the year before."""
    now = F.year("run_ts")
    found = _weekly_papers(df.where(F.col("year").between(now - 1, now)))
    # A run reads two tables of a week's papers each.
    newest = F.max("year").over(W.partitionBy("run_ts"))
    return found.withColumn("_newest", newest).where("year = _newest").drop("year", "_newest", "run_ts")


def _weekly_papers(df: DataFrame) -> DataFrame:
    week = F.regexp_extract("payload", WEEK_HEADING, 1)
    year = F.coalesce(F.nullif(F.regexp_extract("payload", WEEK_HEADING, 2), F.lit("")), F.col("year").cast("string"))
    after = F.get(F.split("payload", WEEK_HEADING, 3), F.lit(1))
    body = F.get(F.split(after, r"(?m)^(?:##\s|---\s*$)", 2), F.lit(0))
    end = F.concat_ws(" ", F.trim(F.element_at(F.split(week, "-"), -1)), year)
    df = df.withColumn("ends", F.coalesce(F.try_to_timestamp(end, F.lit("MMMM d yyyy")), F.try_to_timestamp(end, F.lit("MMM d yyyy")), "run_ts"))
    rows = _entries(df, F.regexp_extract_all(body, F.lit(PAPER_ROW), F.lit(0)))
    part = lambda i: F.regexp_extract("e", PAPER_ROW, i)
    plain = lambda c: F.trim(F.regexp_replace(c, r"\*\*|__|`|<[^>]+>", ""))
    link = F.coalesce(F.nullif(F.regexp_extract(part(4), r"(?i)\[Paper\]\((https?://[^)\s]+)\)", 1), F.lit("")), F.nullif(F.regexp_extract(part(4), r"\((https?://[^)\s]+)\)", 1), F.lit("")))
    paper = F.regexp_extract(link, ARXIV_ID, 1)
    url = F.when(paper != "", F.concat(F.lit("https://arxiv.org/abs/"), paper)).otherwise(link)
    return _items(rows, "ai_papers", plain(part(2)), _by_place(), url, F.col("ends"), description=plain(F.get(F.split(part(3), r"(?i)<br\s*/?>", 2), F.lit(0))), more={"year": F.col("year"), "run_ts": F.col("run_ts")})


def _plain(html: Column) -> Column:
    """What HTML says, on one line, the entities of `normalize.SIGNS` replaced."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for sign, plain in N.SIGNS:
        out = F.replace(out, F.lit(sign), F.lit(plain)) if sign.startswith("&") else out
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def x_trends(df: DataFrame) -> DataFrame:
    """Names of the first trend list of a page with their number of posts; without a list the names of its search links.

    Of names that differ in case only the first search link counts. A name without a number gets n - rank + 1.
    """
    listed = F.regexp_extract("payload", r"(?is)<ol[^>]*trend-card__list[^>]*>(.*?)</ol>", 1)
    rows = F.filter(F.regexp_extract_all(listed, F.lit(r"(?is)(<li\b.*?</li>)"), F.lit(1)), lambda r: r.rlike(r"(?i)<a\b"))
    links = F.regexp_extract_all("payload", F.lit(r"(?is)(<a\b[^>]*href\s*=\s*[\"'][^\"']*(?:twitter|x)\.com/search[^>]*>.*?</a>)"), F.lit(1))
    names = F.transform(links, lambda a: F.lower(_plain(a)))
    links = F.filter(links, lambda a, i: (_plain(a) != "") & (F.array_position(names, F.lower(_plain(a))) == i + 1))
    seen = _entries(df, F.when(F.size(rows) > 0, rows).otherwise(links))
    own = F.regexp_extract("e", r"(?is)(<a\b[^>]*class\s*=\s*[\"'][^\"']*\btrend-link\b[^>]*>.*?</a>)", 1)
    name = _plain(F.coalesce(F.nullif(own, F.lit("")), F.regexp_extract("e", r"(?is)(<a\b.*?</a>)", 1)))
    box = F.regexp_extract("e", r"(?is)(<[^>]*class\s*=\s*[\"'][^\"']*\btweet-count\b[^>]*>[^<]*)", 1)
    count = X.parse_count(F.coalesce(F.nullif(F.regexp_extract(box, r"(?i)data-count\s*=\s*[\"']([^\"']*)", 1), F.lit("")), _plain(box)))
    url = F.concat(F.lit("https://x.com/search?q="), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")))
    return _items(seen, "x_trends24", name, F.coalesce(count, _by_place()), url, more={"tweet_volume": count})


def github_trending(df: DataFrame) -> DataFrame:
    """Repositories of a trending page: `owner/name: description`, or the name in words; today's stars, else 0."""
    rows = F.regexp_extract_all("payload", F.lit(r"(?is)(<article\b[^>]*Box-row.*?</article>)"), F.lit(1))
    seen = _entries(df, rows)
    head = F.regexp_extract("e", r"(?is)<h[12]\b[^>]*>(.*?)</h[12]>", 1)
    repo = F.btrim(F.regexp_extract(head, r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']+)", 1), F.lit("/"))
    about = _plain(F.regexp_extract("e", r"(?is)<p\b[^>]*>(.*?)</p>", 1))
    words = F.regexp_replace(F.regexp_extract(repo, "/(.*)$", 1), "[-_]", " ")
    title = F.substring(F.when(about != "", F.concat(repo, F.lit(": "), about)).otherwise(F.concat(repo, F.lit(" ("), words, F.lit(")"))), 1, 300)
    stars = X.parse_count(F.regexp_extract(_plain(F.col("e")), r"(?i)([0-9,.]+k?)\s+stars?\s+(?:today|this week|this month)", 1))
    found = seen.where(repo != "")
    more = {"repo": repo, "language": F.nullif(_plain(F.regexp_extract("e", r"(?is)(<[^>]*programmingLanguage[^>]*>[^<]*)", 1)), F.lit(""))}
    return _items(found, "github", title, F.coalesce(stars, F.lit(0.0)), F.concat(F.lit("https://github.com/"), repo), description=F.nullif(about, F.lit("")), more=more)


def product_hunt(df: DataFrame) -> DataFrame:
    """Entries of the products feed: `name: tagline` for names shorter than 60 characters."""
    seen = _entries(df, F.from_xml("payload", f"entry array<struct<title:string,link:{_LINKS},content:string,published:string>>", _LENIENT)["entry"])
    tagline = F.substring(_plain(F.coalesce("e.content", F.lit(""))), 1, 300)
    tagline = F.trim(F.regexp_replace(tagline, r"\s*(?:Discussion|Link)\s*\|?\s*", " "))
    name = F.trim(F.coalesce("e.title", F.lit("")))
    title = F.when((tagline != "") & (F.length(name) < 60), F.concat(name, F.lit(": "), tagline)).otherwise(name)
    return _items(seen, "producthunt", title, _by_place(), F.element_at("e.link", -1)["_href"], N.parse_datetime(F.col("e.published"), F.col("run_ts")), description=F.nullif(tagline, F.lit("")))


def all_items(frames: list[DataFrame]) -> DataFrame:
    """Items of all sources, with the columns that all have."""
    out = frames[0].select(*ITEM)
    for f in frames[1:]:
        out = out.unionByName(f.select(*ITEM))
    return out
