"""Queries that write rows of the tables as feed payloads and decode these, with the DuckDB SQL of what must come back.

A payload holds the rows of SIZE consecutive keys, so none grows with a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.functions import normalize as N
from trendspark.functions import text as X
from trendspark.sources import feeds
from trendspark.session import table

SIZE = 40
_ORDERS = f"""o AS (SELECT o_orderkey AS k, o_orderkey // {SIZE} AS no, o_custkey AS cust, o_totalprice AS price, CAST(epoch(o_orderdate) AS BIGINT) AS secs, o_orderdate AS day,
  row_number() OVER (PARTITION BY o_orderkey // {SIZE} ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderkey // {SIZE}) AS n FROM orders)"""
_PARTS = f"""p AS (SELECT p_partkey AS k, p_partkey // {SIZE} AS no, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price,
  row_number() OVER (PARTITION BY p_partkey // {SIZE} ORDER BY p_partkey) AS place, count(*) OVER (PARTITION BY p_partkey // {SIZE}) AS n FROM part)"""
_RUN_TS = "timestamp'2024-01-01 00:00:00'"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _orders(s: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), iso.alias("iso"),
        F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("rfc"), F.unix_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ssX").alias("secs"),
    )


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def _responses(rows: DataFrame, entry: Column) -> DataFrame:
    """(no, es, run_ts): the entries of SIZE consecutive keys in their order."""
    es = F.transform(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))), lambda x: x["e"])
    return rows.groupBy(F.floor(F.col("k") / SIZE).alias("no")).agg(es.alias("es")).withColumn("run_ts", F.expr(_RUN_TS))


def _json(rows: DataFrame, entry: dict[str, Column], wrap: Callable[[Column], Column]) -> DataFrame:
    made = _responses(rows, F.struct(*[c.alias(k) for k, c in entry.items()]))
    return made.withColumn("payload", F.to_json(wrap(F.col("es")))).drop("es")


def _xml(rows: DataFrame, entry: Column, head: str, tail: str) -> DataFrame:
    return _responses(rows, entry).withColumn("payload", F.concat(F.lit(head), F.array_join("es", ""), F.lit(tail))).drop("es")


def _seen(items: DataFrame, *more: str) -> DataFrame:
    at = F.unix_timestamp("ts").alias("secs")
    return items.select("source", "title", "raw_score", "comment_count", "url", at, "description", "rank", *more)


def hacker_news(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    entry = {
        "objectID": (k % 700).cast("string"),
        "title": F.when(k % 3 == 0, "").otherwise(_text("Order ", k)),
        "story_title": _text("Story ", k),
        "url": F.when(k % 5 == 0, "").otherwise(_text("https://example.org/", k)),
        "points": F.col("price"),
        "num_comments": F.col("cust"),
        "created_at_i": F.col("secs"),
    }
    sent = _json(_orders(s, d), entry, lambda es: F.struct(es.alias("hits"))).withColumnRenamed("no", "query_no")
    return _seen(feeds.hacker_news(sent))


def wikipedia(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    name = F.replace(F.col("name"), F.lit(" "), F.lit("_"))
    entry = {"article": F.when(k % 10 == 0, _text("Special:", name)).when(k % 10 == 1, "Main_Page").otherwise(_text(name, "_", k)), "views": F.col("price"), "rank": (k % SIZE + 1).cast("int")}
    sent = _json(_parts(s, d), entry, lambda es: F.struct(F.array(F.struct(es.alias("articles"))).alias("items")))
    sent = sent.withColumn("day", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("no").cast("int")))
    found = feeds.wikipedia_top(sent, cap=20)
    return found.select("title", "raw_score", "url", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("secs"), "rank")


def reddit_json(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    entry = {
        "title": F.when(k % 19 == 0, " ").otherwise(_text("Post ", k)),
        "score": F.col("price"),
        "num_comments": F.col("cust"),
        "permalink": _text("/r/", k % 7, "/", k),
        "created_utc": F.col("secs").cast("double"),
        "selftext": F.when(k % 4 == 0, F.repeat(F.lit("long "), 150)).otherwise(""),
        "subreddit": _text("sub", k % 7),
        "stickied": k % 11 == 0,
        "over_18": k % 13 == 0,
        "promoted": k % 17 == 0,
    }
    data = lambda es: F.struct(F.struct(F.transform(es, lambda e: F.struct(e.alias("data"))).alias("children")).alias("data"))
    sent = _json(_orders(s, d), entry, data).withColumn("feed", F.col("no").cast("string"))
    return _seen(feeds.reddit_listing(sent, limit=30), "subreddit", "metrics_verified")


def reddit_rss(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    entry = _text("<entry><title>Post ", k, '</title><link href="https://www.reddit.com/', k, '"/><category term="sub', k % 7, '"/><updated>', F.col("iso"), "</updated></entry>")
    sent = _xml(_orders(s, d), entry, "<feed>", "</feed>").withColumn("feed", F.lit("all"))
    return _seen(feeds.reddit_rss(sent), "subreddit", "metrics_verified")


def google_trends(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    news = F.when(k % 3 == 0, "").otherwise(_text("<news_item><news_item_title>News ", k, "</news_item_title><news_item_url>https://example.org/n", k, "</news_item_url></news_item>"))
    traffic = F.when(k % 2 == 0, _text(k % 90 + 1, "K+")).otherwise(_text(k % 900 + 1, "+"))
    entry = _text("<item><title>Topic ", k, "</title><approx_traffic>", traffic, "</approx_traffic><pubDate>", F.col("rfc"), "</pubDate>", F.repeat(news, 4), "</item>")
    return _seen(feeds.google_trends(_xml(_orders(s, d), entry, "<rss><channel>", "</channel></rss>")))


def google_news(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    title = F.when(k % 2 == 0, _text("Story ", k, " - Paper ", k % 9)).otherwise(_text("Story ", k, " - Other Paper"))
    source = F.when(k % 2 == 0, _text('<source url="https://example.org">Paper ', k % 9, "</source>")).otherwise("")
    entry = _text("<item><title>", title, "</title><link>https://example.org/", k, "</link><pubDate>", F.col("rfc"), "</pubDate>", source, "</item>")
    return _seen(feeds.google_news(_xml(_orders(s, d), entry, "<rss><channel>", "</channel></rss>")))


def arxiv(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    page = F.when(k % 2 == 0, _text('<link rel="alternate" href="https://arxiv.org/abs/', k, '"/>')).otherwise('<link rel="related" href="https://example.org/x"/>')
    entry = _text("<entry><id>http://arxiv.org/abs/", k, "v1</id><title>Paper\n  number ", k, "</title><summary> ", F.repeat(F.lit("word\n "), 120), "</summary><published>", F.col("iso"), "</published>", page, "<author><name>A ", k % 5, "</name></author></entry>")
    return _seen(feeds.arxiv(_xml(_orders(s, d), entry, "<feed>", "</feed>")).withColumn("by", F.array_join("authors", ",")), "by")


def weekly_papers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    link = F.when(k % 2 == 0, _text("[Paper](https://arxiv.org/pdf/", F.lpad((k % 10_000).cast("string"), 4, "1"), ".", F.lpad((k % 100_000).cast("string"), 5, "0"), "v2.pdf)")).otherwise(_text("[Tweet](https://example.org/", k, ")"))
    row = _text("| ", k % SIZE + 1, ") **Paper `", k, "`** - About ", F.col("cust"), "<br>more of it | ", link, " |\n")
    older = "---\n## Top AI Papers of the Week (May 1 - May 7) - 2023\n| 1) **Old** - old | [Paper](https://example.org/old) |\n"
    sent = _xml(_orders(s, d), row, "# Papers\n## Top AI Papers of the Week (June 3 - June 9) - 2024\n| **Paper** | **Links** |\n| --- | --- |\n", older)
    found = feeds.weekly_papers(sent.withColumn("year", F.lit(2024)))
    return found.select("title", "raw_score", "url", F.date_format("ts", "yyyy-MM-dd").alias("secs"), "description", "rank")


def x_trends(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    count = F.when(k % 3 == 0, "").otherwise(_text('<span class="tweet-count" data-count="', k + 1000, '">', k, "K</span>"))
    row = _text('<li><span><a href="https://twitter.com/search?q=', k, '" class="trend-link">Topic ', k, "</a></span>", count, "</li>")
    sent = _xml(_orders(s, d), row, '<html><ol class="trend-card__list">', '</ol><ol class="trend-card__list"><li><a>Older</a></li></ol></html>')
    return _seen(feeds.x_trends(sent)).drop("comment_count", "description", "secs")


def github(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    about = F.when(k % 3 == 0, "").otherwise(_text('<p class="c">About ', F.col("name"), " &amp; more</p>"))
    stars = F.when(k % 4 == 0, "").otherwise(_text("<span>1,", F.lpad((k % 1000).cast("string"), 3, "0"), " stars today</span>"))
    row = _text('<article class="Box-row"><h2 class="h3"><a href="/owner', k % 9, "/some-repo_", k, '"> owner / repo </a></h2>', about, '<span itemprop="programmingLanguage">Lang', k % 5, "</span>", stars, "</article>")
    found = feeds.github_trending(_xml(_parts(s, d), row, "<html>", "</html>"))
    return found.select("title", "raw_score", "url", "description", "rank", "repo", "language")


def product_hunt(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    name = F.when(k % 5 == 0, F.rpad(_text("Name ", k), 64, "x")).otherwise(_text("Name ", k))
    content = F.when(k % 4 == 0, "").otherwise(_text("&lt;p&gt;Made for ", F.col("name"), "&lt;/p&gt; Discussion | Link"))
    row = _text("<entry><title>", name, '</title><link rel="alternate" href="https://example.org/p', k, '"/><content>', content, "</content><published>2024-05-06T07:08:09Z</published></entry>")
    found = feeds.product_hunt(_xml(_parts(s, d), row, "<feed>", "</feed>"))
    return _seen(found).drop("comment_count")


def all_feeds(s: SparkSession, d: str) -> DataFrame:
    """Items of three feeds as one table: how many of each, their best score and last place."""
    k = F.col("k")
    trends = _xml(_orders(s, d), _text("<item><title>Topic ", k, "</title><approx_traffic>", k % 90 + 1, "K+</approx_traffic></item>"), "<rss><channel>", "</channel></rss>")
    news = _xml(_orders(s, d), _text("<item><title>Story ", k, "</title><link>https://example.org/", k, "</link></item>"), "<rss><channel>", "</channel></rss>")
    repos = _xml(_parts(s, d), _text('<article class="Box-row"><h2><a href="/o/r', k, '">r</a></h2></article>'), "<html>", "</html>")
    both = feeds.all_items([feeds.google_trends(trends), feeds.google_news(news), feeds.github_trending(repos)])
    return both.groupBy("source").agg(F.count("*").alias("items"), F.max("raw_score").alias("best"), F.max("rank").alias("last"), F.countDistinct("title").alias("titles"))


def parsed_counts(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    forms = F.array(_text(q, "K"), _text(" ", q, ".5m "), _text("1,", F.lpad(q.cast("string"), 3, "0"), "+"), _text("about ", q), _text(q, "B views"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.slice(forms, (F.col("l_orderkey") % 5 + 1).cast("int"), 1)).alias("said"))
    return rows.select("l_orderkey", "l_linenumber", X.parse_count(F.col("said")).alias("number"))


def parsed_times(s: SparkSession, d: str) -> DataFrame:
    """Dates written as RFC 822, as ISO 8601 or not at all, read back; what is no date gives the time of the run."""
    said = F.when(F.col("k") % 3 == 0, F.col("rfc")).when(F.col("k") % 3 == 1, F.col("iso")).otherwise("no date")
    return _orders(s, d).select("k", F.unix_timestamp(N.parse_datetime(said, F.timestamp_seconds(F.lit(1_700_000_000)))).alias("secs"))


def coerced_ids(s: SparkSession, d: str) -> DataFrame:
    ids = F.array(F.col("k").cast("string"), _text(" #", F.col("cust"), " "), _text("x", F.col("k")), F.lit("1.5"), F.lit(""))
    return _orders(s, d).select("k", F.array_join(N.coerce_ids(ids).cast("array<string>"), ",").alias("ids"))


def clamped_relevance(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity") / 4 - 1
    said = F.when(F.col("l_orderkey") % 7 == 0, "high").when(F.col("l_orderkey") % 7 == 1, "NaN").otherwise(q.cast("string"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", N.relevance(said).alias("relevance"))


def hashtag_words(s: SparkSession, d: str) -> DataFrame:
    """Names of parts written as hashtags, taken apart again."""
    camel = F.replace(F.initcap("name"), F.lit(" "), F.lit(""))
    tag = F.when(F.col("k") % 4 == 0, _text("#", F.replace("name", F.lit(" "), F.lit("_")))).when(F.col("k") % 4 == 1, _text("#", F.col("name"))).when(F.col("k") % 4 == 2, _text("#", camel, F.col("size"))).otherwise(_text("##", camel))
    return _parts(s, d).select("k", N.split_hashtag(tag).alias("words"))


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    place, null = "CAST(place AS INT) AS rank", "CAST(NULL AS BIGINT) AS comment_count"
    nothing = "CAST(NULL AS VARCHAR) AS description"
    by_place = "CAST(n - place + 1 AS DOUBLE) AS raw_score"
    return {
        "feed_hackernews": (
            hacker_news,
            f"""WITH {_ORDERS}, f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k % 700 ORDER BY no, place) = 1)
            SELECT 'hackernews' AS source, CASE WHEN k % 3 = 0 THEN 'Story ' ELSE 'Order ' END || k AS title, price AS raw_score, CAST(cust AS BIGINT) AS comment_count,
            CASE WHEN k % 5 = 0 THEN 'https://news.ycombinator.com/item?id=' || (k % 700) ELSE 'https://example.org/' || k END AS url, secs, {nothing}, {place} FROM f""",
        ),
        "feed_wikipedia": (
            wikipedia,
            f"""WITH {_PARTS}, kept AS (SELECT * FROM p WHERE k % 10 NOT IN (0, 1) QUALIFY row_number() OVER (PARTITION BY no ORDER BY k) <= 20)
            SELECT name || ' ' || k AS title, price AS raw_score, 'https://en.wikipedia.org/wiki/' || replace(name, ' ', '_') || '_' || k AS url,
            strftime(DATE '2024-01-01' + CAST(no AS INT), '%Y-%m-%d') || ' 23:59' AS secs, {place} FROM kept""",
        ),
        "feed_reddit_json": (
            reddit_json,
            f"""WITH {_ORDERS}, kept AS (SELECT * FROM o WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 QUALIFY row_number() OVER (PARTITION BY no ORDER BY k) <= 30)
            SELECT 'reddit' AS source, 'Post ' || k AS title, price AS raw_score, CAST(cust AS BIGINT) AS comment_count, 'https://www.reddit.com/r/' || (k % 7) || '/' || k AS url, secs,
            CASE WHEN k % 4 = 0 THEN substr(repeat('long ', 150), 1, 500) END AS description, {place}, 'sub' || (k % 7) AS subreddit, true AS metrics_verified FROM kept""",
        ),
        "feed_reddit_rss": (
            reddit_rss,
            f"""WITH {_ORDERS} SELECT 'reddit' AS source, 'Post ' || k AS title, CAST(NULL AS DOUBLE) AS raw_score, {null}, 'https://www.reddit.com/' || k AS url, secs, {nothing}, {place},
            'sub' || (k % 7) AS subreddit, false AS metrics_verified FROM o""",
        ),
        "feed_google_trends": (
            google_trends,
            f"""WITH {_ORDERS} SELECT 'google_trends' AS source, 'Topic ' || k AS title, CASE WHEN k % 2 = 0 THEN (k % 90 + 1) * 1000e0 ELSE k % 900 + 1 END AS raw_score, {null},
            CASE WHEN k % 3 = 0 THEN 'https://www.google.com/search?q=Topic+' || k ELSE 'https://example.org/n' || k END AS url, secs,
            CASE WHEN k % 3 <> 0 THEN 'News ' || k || ' | News ' || k || ' | News ' || k END AS description, {place} FROM o""",
        ),
        "feed_google_news": (
            google_news,
            f"WITH {_ORDERS} SELECT 'google_news' AS source, 'Story ' || k AS title, {by_place}, {null}, 'https://example.org/' || k AS url, secs, {nothing}, {place} FROM o",
        ),
        "feed_arxiv": (
            arxiv,
            f"""WITH {_ORDERS} SELECT 'arxiv' AS source, 'Paper number ' || k AS title, {by_place}, {null}, CASE WHEN k % 2 = 0 THEN 'https://arxiv.org/abs/' || k ELSE 'http://arxiv.org/abs/' || k || 'v1' END AS url, secs,
            substr(trim(repeat('word ', 120)), 1, 500) AS description, {place}, 'A ' || (k % 5) AS "by" FROM o""",
        ),
        "feed_weekly_papers": (
            weekly_papers,
            f"""WITH {_ORDERS} SELECT 'Paper ' || k AS title, {by_place}, CASE WHEN k % 2 = 0 THEN 'https://arxiv.org/abs/' || lpad(CAST(k % 10000 AS VARCHAR), 4, '1') || '.' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0')
            ELSE 'https://example.org/' || k END AS url, '2024-06-09' AS secs, 'About ' || cust AS description, {place} FROM o""",
        ),
        "feed_x_trends": (
            x_trends,
            f"""WITH {_ORDERS} SELECT 'x_trends24' AS source, 'Topic ' || k AS title, CAST(CASE WHEN k % 3 = 0 THEN n - place + 1 ELSE k + 1000 END AS DOUBLE) AS raw_score,
            'https://x.com/search?q=Topic%20' || k AS url, {place} FROM o""",
        ),
        "feed_github": (
            github,
            f"""WITH {_PARTS}, r AS (SELECT *, 'owner' || (k % 9) || '/some-repo_' || k AS repo, CASE WHEN k % 3 <> 0 THEN 'About ' || name || ' & more' END AS about FROM p)
            SELECT repo || CASE WHEN about IS NULL THEN ' (some repo ' || k || ')' ELSE ': ' || about END AS title, CASE WHEN k % 4 = 0 THEN 0e0 ELSE 1000e0 + k % 1000 END AS raw_score,
            'https://github.com/' || repo AS url, about AS description, {place}, repo, 'Lang' || (k % 5) AS language FROM r""",
        ),
        "feed_producthunt": (
            product_hunt,
            f"""WITH {_PARTS}, r AS (SELECT *, CASE WHEN k % 5 = 0 THEN rpad('Name ' || k, 64, 'x') ELSE 'Name ' || k END AS called, CASE WHEN k % 4 <> 0 THEN 'Made for ' || name END AS tagline FROM p)
            SELECT 'producthunt' AS source, called || CASE WHEN tagline IS NOT NULL AND k % 5 <> 0 THEN ': ' || tagline ELSE '' END AS title, {by_place}, 'https://example.org/p' || k AS url,
            CAST(epoch(TIMESTAMP '2024-05-06 07:08:09') AS BIGINT) AS secs, tagline AS description, {place} FROM r""",
        ),
        "feeds_united": (
            all_feeds,
            f"""WITH {_ORDERS}, {_PARTS} SELECT 'google_trends' AS source, count(*) AS items, CAST(max((k % 90 + 1) * 1000) AS DOUBLE) AS best, CAST(max(place) AS INT) AS last, count(*) AS titles FROM o
            UNION ALL SELECT 'google_news', count(*), CAST(max(n) AS DOUBLE), CAST(max(place) AS INT), count(*) FROM o UNION ALL SELECT 'github', count(*), 0e0, CAST(max(place) AS INT), count(*) FROM p""",
        ),
        "parsed_counts": (
            parsed_counts,
            """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN q * 1000e0 WHEN 1 THEN (q + 0.5e0) * 1000000e0 WHEN 2 THEN 1000e0 + q WHEN 4 THEN q * 1000000000e0 END AS number
            FROM (SELECT *, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem)""",
        ),
        "parsed_times": (parsed_times, f"WITH {_ORDERS} SELECT k, CASE WHEN k % 3 = 2 THEN 1700000000 ELSE secs END AS secs FROM o"),
        "coerced_ids": (coerced_ids, f"WITH {_ORDERS} SELECT k, k || ',' || cust AS ids FROM o"),
        "clamped_relevance": (
            clamped_relevance,
            """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 < 2 THEN 5 ELSE CAST(greatest(1, least(10, round_even(l_quantity / 4 - 1, 0))) AS INT) END AS relevance FROM lineitem""",
        ),
        "hashtag_words": (
            hashtag_words,
            f"""WITH {_PARTS}, w AS (SELECT *, array_to_string(list_transform(string_split(name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS capital FROM p)
            SELECT k, CASE k % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN capital || ' ' || size ELSE capital END AS words FROM w""",
        ),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items()}
