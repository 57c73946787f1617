"""Queries over feeds with fallbacks, remote reports, pages read for a question and reports as text, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.operators import chat as C
from trendspark.operators import groups as G
from trendspark.operators import pages as P
from trendspark.operators import reports as R
from trendspark.plans import topics
from trendspark.plans.payloads import _ORDERS, SIZE, _json, _orders, _responses, _text, _xml
from trendspark.plans.topics import members
from trendspark.session import scratch_path, table
from trendspark.sources import feeds, ingest
from trendspark.sources import store as S

START, NOW = 1_704_067_200, 850_000_000
#: Feeds of a run, tags of a page, and trends' addresses that recur.
FEEDS, TAGS = 5, 30
REPORT = "run_id string, started_at double, headlines array<string>"


def reddit_fallback(s: SparkSession, d: str) -> DataFrame:
    """Orders as posts of feeds: the same five feeds in every run, some refused, some out of order."""
    no, k = F.col("no"), F.col("k")
    entry = {"title": _text("Post ", k), "score": F.col("price"), "created_utc": F.col("secs").cast("double")}
    data = lambda es: F.struct(F.struct(F.transform(es, lambda e: F.struct(e.alias("data"))).alias("children")).alias("data"))
    at = F.timestamp_seconds(F.floor(no / FEEDS) + START)
    status = F.when(no % 7 == 3, 429).when(no % 11 == 4, 500).otherwise(200)
    listings = _json(_orders(s, d), entry, data).select((no % FEEDS).cast("string").alias("feed"), (no % FEEDS).alias("place"), status.alias("status"), "payload", at.alias("run_ts"))
    atom = _text("<entry><title>Post ", k, '</title><link href="https://www.reddit.com/', k, '"/><updated>', F.col("iso"), "</updated></entry>")
    rss = _xml(_orders(s, d), atom, "<feed>", "</feed>").select((no % FEEDS).cast("string").alias("feed"), "payload", at.alias("run_ts"))
    return feeds.reddit_feeds(listings, rss).select("title", "raw_score", "metrics_verified", "feed", "nth")


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Payloads of four sources in three runs: a search with broken answers, news that is cut in one run, a list of which the
    first good day counts, and papers that were never fetched."""
    no, k = F.col("no"), F.col("k")
    run = no % 3
    row = lambda df, source, part, status, error, payload: df.select(run.alias("run_id"), F.lit(source).alias("source"), no.cast("int").alias("place"), part.cast("string").alias("part"), F.lit(None).cast("string").alias("form"), status.alias("status"), error.cast("string").alias("error"), payload.alias("payload"), F.timestamp_seconds(START + run).alias("run_ts"))
    fine, none = F.lit(200), F.lit(None)
    hits = _json(_orders(s, d), {"objectID": k.cast("string"), "title": _text("Story ", k), "points": F.col("price")}, lambda es: F.struct(es.alias("hits")))
    news = _xml(_orders(s, d), _text("<item><title>News ", k, "</title><link>https://n/", k, "</link></item>"), "<rss><channel>", "</channel></rss>")
    pages = _json(_orders(s, d), {"article": _text("Page_", k), "views": F.col("price")}, lambda es: F.struct(F.array(F.struct(es.alias("articles"))).alias("items")))
    papers = _xml(_orders(s, d), _text("<entry><id>", k, "</id><title>Paper</title></entry>"), "<feed>", "</feed>")
    return (
        row(hits, "hackernews", no, fine, none, F.when(no % 7 == 3, "{oops").otherwise(F.col("payload")))
        .unionByName(row(news, "google_news", no, fine, none, F.when(no == 1, F.substring(F.col("payload"), 1, 60)).otherwise(F.col("payload"))))
        .unionByName(row(pages, "wikipedia", F.lit("2024-01-01"), F.when(no < 4, 404).otherwise(200), none, F.col("payload")))
        .unionByName(row(papers, "arxiv", no, fine, F.when(run == 2, "timed out"), F.col("payload")))
    )


def tiktok(s: SparkSession, d: str) -> DataFrame:
    """Orders as hashtags: in JSON, in spans alone, or in JSON that can't be read."""
    no, k = F.col("no"), F.col("k")
    name = _text(F.when(k % 4 == 0, "#Tag").otherwise("tag"), k % TAGS)
    entry = {"hashtagName": name, "videoViews": F.when(k % 3 != 0, F.col("price")), "publishCnt": F.when(k % 2 == 0, F.col("cust")), "isPromoted": k % 13 == 0, "industryInfo": F.struct(_text("i", k % 5).alias("value"))}
    wrap = lambda es: F.struct(F.struct(F.array(F.struct(F.lit(1).alias("other"), es.alias("list"))).alias("data")).alias("props"))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.when(no % 7 == 6, "{oops").otherwise(F.col("payload")), F.lit("</script>"))
    told = _json(_orders(s, d), entry, wrap).where(no % 3 != 2).select(no.alias("page"), html.alias("payload"), "run_ts")
    spans = _responses(_orders(s, d), _text("<span># Tag", k % TAGS, "</span>")).where(no % 3 == 2)
    spans = spans.select(no.alias("page"), F.concat(F.lit("<html><p>No # tags</p>"), F.array_join("es", "")).alias("payload"), "run_ts")
    return feeds.tiktok_hashtags(told.unionByName(spans)).select("title", "raw_score", "url", "rank", "industry")


def papers_of_the_year(s: SparkSession, d: str) -> DataFrame:
    """Orders as papers of weekly tables: every other run's year has none yet."""
    no, k = F.col("no"), F.col("k")
    at = F.timestamp_seconds(no + START)
    row = lambda name: _text("| ", k % SIZE + 1, ") **", name, " ", k, "** - On orders. | [Paper](https://arxiv.org/abs/2401.", F.lpad((k % 99999).cast("string"), 5, "0"), "v2) |\n")
    head = "# Papers\n## Top AI Papers of the Week (January 1 - January 7)\n| **Paper** | **Links** |\n|---|---|\n"
    now = _responses(_orders(s, d), row("New")).select(F.year(at).alias("year"), F.when(no % 2 == 0, F.concat(F.lit(head), F.array_join("es", ""))).otherwise("# Papers\n").alias("payload"), at.alias("run_ts"))
    was = _responses(_orders(s, d), row("Old")).select((F.year(at) - 1).alias("year"), F.concat(F.lit(head), F.array_join("es", "")).alias("payload"), at.alias("run_ts"))
    return feeds.papers_of_the_year(now.unionByName(was)).select("title", "raw_score", "url", "rank")


def cloud_report(s: SparkSession, d: str) -> DataFrame:
    """Nations as remote runs, not all successful, each with two reports of its suppliers."""
    cache, n = scratch_path(s, "cloud"), F.col("n_nationkey")
    runs = table(s, d, "nation").select(n.cast("string").alias("cloud_run"), (n * 60).alias("created_at"), F.when(n % 5 == 4, "failure").otherwise("success").alias("status"))
    named = table(s, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))
    report = lambda mark: F.to_json(F.struct(_text(mark, n).alias("run_id"), (n * 60).cast("double").alias("started_at"), F.slice(F.col("names"), 1, 3).alias("headlines")))
    told = table(s, d, "nation").join(named, n == F.col("s_nationkey"), "left")
    for mark in ("a", "b"):
        told.select(n.cast("string").alias("run"), F.lit(mark).alias("part"), report(mark).alias("value")).write.mode("append").partitionBy("run", "part").text(cache)
    found = S.cloud_report(s, runs, cache, REPORT, "run={run}", "part-*")
    return found.select("cloud_run", "report.run_id", "report.started_at", F.coalesce(F.array_join("report.headlines", "|"), F.lit("")).alias("headlines"), "note")


def _wanted(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    urls = F.array(_text("https://news.google.com/", k), _text("https://example.org/", F.col("o_custkey") * 2), _text("https://example.org/", k % 89), F.lit("https://example.org/z"))
    return P.deep_reads(table(s, d, "orders").select(k.alias("rank"), _text("Order ", k).alias("headline"), urls.alias("source_urls")))


def _cache(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(s, d, "customer").select(_text("https://example.org/", k).alias("url"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("text"))


def _report(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as runs, their orders as trends."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    runs = table(s, d, "customer").select(c.alias("run_id"), _text("run ", c).alias("origin_label"), (c * 3600).alias("started_at"), (c * 3600 + 7200).alias("now"), F.lit("none").alias("llm_mode"), (c % 50).alias("ingested"))
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    windows = F.when(k % 2 == 0, F.array(F.struct(F.lit(6.0).alias("hours"), (k % 4).cast("double").alias("growth")), F.struct(F.lit(24.0).alias("hours"), F.lit(None).cast("double").alias("growth"))))
    clusters = table(s, d, "orders").select(
        F.col("o_custkey").alias("run_id"), rank.alias("rank"), F.when(k % 2 == 0, "Tech").otherwise("News").alias("category"), _text("Order ", k).alias("headline"), (k % 10 + 1).alias("relevance"), (k % 90).cast("double").alias("velocity"),
        F.lit("STEADY").alias("momentum"), windows.alias("windows"), (k % 7 + 2).alias("items"), F.when(k % 3 == 0, F.array(F.lit("reddit"), F.lit("github"))).otherwise(F.array().cast("array<string>")).alias("sources"), _text("Sent ", k).alias("summary"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(_text("E", k), F.lit("Ship"))).alias("entities"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: _text("https://example.org/", k, "/", i))).alias("source_urls"),
    )
    good = runs.select("run_id", F.lit(1).alias("place"), F.lit("reddit").alias("source"), F.lit(True).alias("ok"), (F.col("run_id") % 40).alias("item_count"), F.lit(None).cast("string").alias("error"))
    bad = runs.where("run_id % 3 = 0").select("run_id", F.lit(2).alias("place"), F.lit("github").alias("source"), F.lit(False).alias("ok"), F.lit(0).cast("long").alias("item_count"), F.when(F.col("run_id") % 2 == 0, "timed out").alias("error"))
    earlier = runs.where("run_id % 2 = 0").select("run_id", F.explode(F.array(F.lit(0), F.lit(3600))).alias("started_at")).withColumn("headlines", F.when(F.col("started_at") > 0, F.array(F.lit("One"), F.lit("Two"))).otherwise(F.array().cast("array<string>")))
    return runs, clusters, good.unionByName(bad), earlier


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Conversations about the fifteen best-scored titles, with addresses of the table of pages, two thirds of them read before."""
    top = members(s, d).orderBy(F.desc("score"), "item_id").limit(15)
    trends = top.select(F.row_number().over(W.orderBy(F.desc("score"), "item_id")).alias("rank"), F.col("title").alias("headline"), F.slice(F.split("text_key", " "), 1, 2).alias("entities"))
    pages = table(s, d, "pages").select("page_id", "url")
    of = pages.withColumn("rank", (F.col("page_id") % 15 + 1).cast("int")).groupBy("rank").agg(F.concat(F.array(F.lit("https://news.google.com/x")), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda p: p["url"]), 1, 3)).alias("source_urls"))
    cache = pages.where("page_id % 3 <> 0").select("url", F.when(F.col("page_id") % 2 == 0, "").otherwise(_text("Page ", F.col("page_id"))).alias("text"))
    said = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    got = C.turns(said, trends.join(of, "rank", "left"), cache, s.range(1).select(F.lit("REPORT").alias("text")), "RULES")
    return got.select("conv_id", "outcome", "question", F.array_join("ranks", ",").alias("ranks"), F.array_join("to_read", " ").alias("to_read"), "told", F.size("messages").cast("long").alias("n_messages"))


def projection(s: SparkSession, d: str) -> DataFrame:
    """The JSON of each run read back."""
    trend = "rank int, headline string, relevance long, velocity double, entities array<string>, urls array<string>, items long"
    schema = f"available boolean, run_id long, started_at string, age_hours double, trends array<struct<{trend.replace(' ', ':').replace(',:', ',')}>>, source_stats array<struct<source:string,ok:boolean,item_count:long,error:string>>"
    j = R.api_projection(*_report(s, d)[:3]).select(F.from_json("payload", schema).alias("j"))
    rows = j.select("j.available", "j.run_id", "j.started_at", "j.age_hours", F.size("j.source_stats").alias("sources"), F.explode_outer("j.trends").alias("t"))
    return rows.select("available", "run_id", "started_at", "age_hours", "sources", "t.rank", "t.headline", "t.velocity", F.size("t.urls").alias("urls"), F.array_join("t.entities", "|").alias("entities"), "t.items")


def _lexical(s: SparkSession, d: str) -> DataFrame:
    return G.topic_groups(members(s, d))


_RUNS = """r AS (SELECT c_custkey AS c FROM customer), t AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)"""
_LINES = """'#' || rank || ' [' || CASE WHEN k % 2 = 0 THEN 'Tech' ELSE 'News' END || '] Order ' || k || chr(10) || '   relevance ' || (k % 10 + 1) || '/10 | velocity ' || (k % 90) || ' STEADY' || CASE WHEN k % 2 = 0 THEN ' (6h +' || (k % 4 * 100) || '%)' ELSE '' END
  || ' | ' || (k % 7 + 2) || ' items from ' || CASE WHEN k % 3 = 0 THEN 'Reddit and GitHub' ELSE 'unknown sources' END || chr(10) || '   summary: Sent ' || k || CASE WHEN k % 5 = 0 THEN '' ELSE chr(10) || '   entities: E' || k || ', Ship' END
  || CASE WHEN k % 6 = 0 THEN '' ELSE array_to_string(list_transform([1, 2, 3, 4], lambda i: chr(10) || '   link: https://example.org/' || k || '/' || i), '') END"""
_STAMP = "strftime(make_timestamp(CAST(c AS BIGINT) * 3600000000), {})"


def _queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    lexical = topics.oracle_sql()["lexical_components"]
    wanted = """w AS (SELECT o_orderkey AS rank, 1 AS nth, 'https://example.org/' || (o_custkey * 2) AS url, 'Order ' || o_orderkey AS headline FROM orders UNION ALL SELECT o_orderkey, 2, 'https://example.org/' || (o_orderkey % 89), 'Order ' || o_orderkey FROM orders),
    c AS (SELECT 'https://example.org/' || c_custkey AS url, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS text FROM customer)"""
    return {
        "feed_reddit_fallback": (
            reddit_fallback,
            f"""WITH {_ORDERS}, f AS (SELECT DISTINCT no, no // {FEEDS} AS run, no % {FEEDS} AS spot, CASE WHEN no % 7 = 3 THEN 429 WHEN no % 11 = 4 THEN 500 ELSE 200 END AS status FROM o),
            g AS (SELECT *, status = 200 AND coalesce(spot < min(spot) FILTER (status = 429) OVER (PARTITION BY run), true) AS opened FROM f)
            SELECT 'Post ' || k AS title, CASE WHEN opened THEN price END AS raw_score, opened AS metrics_verified, CAST(no % {FEEDS} AS VARCHAR) AS feed,
              CAST(row_number() OVER (PARTITION BY run ORDER BY opened DESC, CASE WHEN opened THEN price ELSE 0 END DESC, CASE WHEN opened THEN 999 ELSE place END, spot, place) AS INT) AS nth FROM o JOIN g USING (no)""",
        ),
        "chat_turns": (
            _turns,
            f"""WITH {topics._D}, trends AS (SELECT row_number() OVER (ORDER BY score DESC, item_id) AS rank, tokens, string_split(text_key, ' ')[1:2] AS entities FROM mem QUALIFY rank <= 15),
            tail AS (SELECT *, substr(text, 1, 4000) AS said FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5),
            convs AS (SELECT conv_id, arg_max(role, turn) = 'user' AS asks, arg_max(said, turn) AS question, count(*) AS n_messages FROM tail GROUP BY 1),
            q AS (SELECT conv_id AS question_id, lower(question) AS title FROM convs WHERE asks),
            r AS (SELECT question_id, title, list_filter(list_transform(regexp_extract_all(title, {topics._q(topics.L.TREND_REF)}, 1), lambda x: CAST(x AS INT)), lambda x: x BETWEEN 1 AND n) AS refs FROM q CROSS JOIN (SELECT count(*) AS n FROM trends)),
            direct AS (SELECT question_id, rank, min(pos) AS pos FROM (SELECT question_id, unnest(refs) AS rank, generate_subscripts(refs, 1) AS pos FROM r) GROUP BY 1, 2),
            met AS (SELECT question_id, rank, len(list_intersect({topics._SIG}, tokens)) AS overlap, len(list_filter(entities, lambda e: length(e) >= 3 AND contains(title, e))) > 0 AS named FROM r CROSS JOIN trends WHERE len(refs) = 0),
            ranked AS (SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS nth FROM direct UNION ALL
              SELECT question_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY overlap + CASE WHEN named THEN 2 ELSE 0 END DESC, rank DESC) FROM met WHERE overlap >= 2 OR named),
            found AS (SELECT * FROM ranked WHERE nth <= {C.TRENDS}),
            urls AS (SELECT page_id % 15 + 1 AS rank, page_id, url, row_number() OVER (PARTITION BY page_id % 15 ORDER BY page_id) AS place FROM pages QUALIFY place <= least(3, {P.SHOWN})),
            asked AS (SELECT question_id, nth, place, rank, url, CASE WHEN page_id % 3 <> 0 THEN CASE WHEN page_id % 2 = 0 THEN '' ELSE 'Page ' || page_id END END AS text FROM found JOIN urls USING (rank)),
            p AS (SELECT question_id, string_agg(url, ' ' ORDER BY nth, place) FILTER (text IS NULL) AS to_read, string_agg('[#' || rank || '] ' || url || chr(10) || text, chr(10) ORDER BY nth, place) FILTER (text <> '') AS read FROM asked GROUP BY 1),
            f AS (SELECT question_id, string_agg(rank, ',' ORDER BY nth) AS ranks FROM found GROUP BY 1)
            SELECT conv_id, CASE WHEN asks THEN 'ask' ELSE 'no question' END AS outcome, CASE WHEN asks THEN question END AS question, CASE WHEN asks THEN coalesce(ranks, '') END AS ranks, CASE WHEN asks THEN coalesce(to_read, '') END AS to_read,
              CASE WHEN asks THEN 'RULES' || chr(10) || chr(10) || 'REPORT' || coalesce(chr(10) || chr(10) || 'EXCERPTS:' || chr(10) || read, '') END AS told, n_messages
            FROM convs LEFT JOIN f ON f.question_id = conv_id LEFT JOIN p ON p.question_id = conv_id""",
        ),
        "feeds_stats": (
            lambda s, d: ingest.ingest(_stored(s, d), ["arxiv", "google_news", "hackernews", "wikipedia"], None)[1],
            f"""WITH {_ORDERS}, r AS (SELECT *, no % 3 AS run_id FROM o), days AS (SELECT run_id, min(no) AS no FROM r WHERE no >= 4 GROUP BY 1)
            SELECT run_id, 'hackernews' AS source, true AS ok, count(*) FILTER (no % 7 <> 3) AS item_count, CAST(NULL AS VARCHAR) AS error FROM r GROUP BY 1
            UNION ALL SELECT run_id, 'google_news', run_id <> 1, CASE WHEN run_id <> 1 THEN count(*) ELSE 0 END, CASE WHEN run_id = 1 THEN 'invalid XML' END FROM r GROUP BY 1
            UNION ALL SELECT run_id, 'wikipedia', true, least(40, count(*)), NULL FROM r JOIN days USING (run_id, no) GROUP BY 1
            UNION ALL SELECT run_id, 'arxiv', run_id <> 2, CASE WHEN run_id <> 2 THEN count(*) ELSE 0 END, CASE WHEN run_id = 2 THEN 'timed out' END FROM r GROUP BY 1""",
        ),
        "feed_tiktok": (
            tiktok,
            f"""WITH {_ORDERS}, p AS (SELECT *, no % 3 = 2 AS spans, CASE WHEN no % 3 = 2 OR k % 4 = 0 THEN 'Tag' ELSE 'tag' END || k % {TAGS} AS name FROM o WHERE no % 3 = 2 OR no % 7 <> 6),
            kept AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY no, lower(name) ORDER BY place) = 1)
            SELECT '#' || name AS title, CAST(coalesce(CASE WHEN NOT spans THEN coalesce(CASE WHEN k % 3 <> 0 THEN nullif(price, 0) END, CASE WHEN k % 2 = 0 THEN nullif(cust, 0) END) END, n - place + 1) AS DOUBLE) AS raw_score, 'https://www.tiktok.com/tag/' || name AS url, CAST(place AS INT) AS rank,
              CASE WHEN NOT spans THEN 'i' || k % 5 END AS industry FROM kept WHERE spans OR k % 13 <> 0""",
        ),
        "feed_papers_of_year": (
            papers_of_the_year,
            f"""WITH {_ORDERS} SELECT CASE WHEN no % 2 = 0 THEN 'New ' ELSE 'Old ' END || k AS title, CAST(n - place + 1 AS DOUBLE) AS raw_score, 'https://arxiv.org/abs/2401.' || lpad(CAST(k % 99999 AS VARCHAR), 5, '0') AS url, CAST(place AS INT) AS rank FROM o""",
        ),
        "cloud_report": (
            cloud_report,
            """WITH n AS (SELECT max(n_nationkey) AS k FROM nation WHERE n_nationkey % 5 <> 4), l AS (SELECT list(s_name ORDER BY s_name)[1:3] AS names FROM supplier JOIN n ON s_nationkey = k)
            SELECT CAST(k AS VARCHAR) AS cloud_run, 'b' || k AS run_id, k * 60e0 AS started_at, coalesce(array_to_string(names, '|'), '') AS headlines, CAST(NULL AS VARCHAR) AS note FROM n, l""",
        ),
        "pages_to_fetch": (lambda s, d: P.to_fetch(_wanted(s, d), _cache(s, d)), f"WITH {wanted} SELECT url, arg_min(headline, (rank, nth)) AS headline FROM w WHERE url NOT IN (SELECT url FROM c) GROUP BY 1"),
        "page_excerpts": (lambda s, d: P.excerpts(_wanted(s, d), _cache(s, d)), f"WITH {wanted} SELECT rank, CAST(nth AS INT) AS nth, url, text FROM w JOIN c USING (url) WHERE text <> ''"),
        "run_ages": (
            lambda s, d: table(s, d, "orders").select("o_orderkey", S.age_hours(F.unix_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), F.lit(NOW)).alias("hours")),
            f"SELECT o_orderkey, greatest(0e0, ({NOW} - CAST(floor(epoch(o_orderdate)) AS BIGINT)) / 3600e0) AS hours FROM orders",
        ),
        "report_grounding": (
            lambda s, d: R.grounding(*_report(s, d)),
            f"""WITH {_RUNS}, b AS (SELECT c, count(*) AS n, string_agg({_LINES}, chr(10) ORDER BY rank) AS lines FROM t GROUP BY 1)
            SELECT c AS run_id, 'REPORT: run ' || c || ', started ' || {_STAMP.format("'%Y-%m-%d %H:%M'")} || ' UTC (2.0 hours ago), engine none, ' || (c % 50) || ' items ingested, ' || coalesce(n, 0) || ' trends.' || chr(10) ||
            'Sources OK: reddit ' || (c % 40) || CASE WHEN c % 3 = 0 THEN '. Failed: github (' || CASE WHEN c % 2 = 0 THEN 'timed out' ELSE 'failed' END || ')' ELSE '' END || chr(10) || chr(10) || 'TRENDS (ranked):' || chr(10) ||
            coalesce(lines, '{R.NO_TRENDS}') || CASE WHEN c % 2 = 0 THEN chr(10) || chr(10) || 'EARLIER RUNS (local history, newest first):' || chr(10) || '- 1970-01-01 01:00 UTC: One; Two' || chr(10) || '- 1970-01-01 00:00 UTC: no trends' ELSE '' END AS text
            FROM r LEFT JOIN b USING (c)""",
        ),
        "report_projection": (
            projection,
            f"""WITH {_RUNS} SELECT true AS available, c AS run_id, {_STAMP.format("'%Y-%m-%dT%H:%M:%S+00:00'")} AS started_at, 2e0 AS age_hours, CASE WHEN c % 3 = 0 THEN 2 ELSE 1 END AS sources, CAST(rank AS INT) AS rank, 'Order ' || k AS headline, CAST(k % 90 AS DOUBLE) AS velocity,
            CASE WHEN k % 6 = 0 THEN 0 WHEN k IS NOT NULL THEN 5 END AS urls, CASE WHEN k % 5 = 0 THEN '' ELSE 'E' || k || '|Ship' END AS entities, k % 7 + 2 AS items FROM r LEFT JOIN t USING (c)""",
        ),
        "topic_groups": (_lexical, f"SELECT item_id, group_id FROM ({lexical}) QUALIFY count(*) OVER (PARTITION BY group_id) > 1"),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _queries().items()}
