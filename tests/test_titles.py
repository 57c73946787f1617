"""Rules that the driver's tables seldom meet."""

from pyspark.sql import functions as F

from trendspark.functions import normalize as N
from trendspark.operators import titles

TITLES = [
    ("tiktok", "#fyp", "generic_hashtag"), ("tiktok", "#HappyMondayAll", "generic_hashtag"), ("reddit", "#fyp", None),
    ("google_news", "My dog ate the budget", "personal_anecdote"), ("hackernews", "My dog ate the budget", None),
    ("reddit", "Photo of a comet over Rome", "meme_or_photo"), ("x_trends24", "Puppies at the White House", "pet_post"),
    ("wikipedia", "Packers injury report for Sunday", "box_score_or_betting"), ("arxiv", "On odds and evens", None), ("reddit", "Love 20 pts and 7 reb", "box_score_or_betting"),
    ("reddit", None, None), ("reddit", "", None),
]


def test_title_rules(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(TITLES)], "i int, source string, title string")
    assert [r.title_reason for r in titles.title_reason(df).orderBy("i").collect()] == [r for *_, r in TITLES]


def test_reddit_rules(spark):
    df = spark.createDataFrame([("reddit", "AWW", True, 1), ("reddit", "news", False, 10), ("reddit", "news", False, 11), ("reddit", "news", None, None), ("github", "aww", False, None)], "source string, subreddit string, metrics_verified boolean, rank int")
    assert [r.reddit_reason for r in titles.reddit_reason(df).collect()] == ["reddit_low_signal_subreddit", None, "reddit_unverified_metrics", "reddit_unverified_metrics", None]


def test_labels(spark):
    df = spark.createDataFrame([("Tech",), ("world news",), ("the gaming desk",), ("nothing",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(N.coerce_category(F.col("c"))).collect()] == ["Tech", "News", "Entertainment", "News", "News", "News"]
    shown = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "s array<string>").select(N.display_sources(F.col("s")))
    assert [r[0] for r in shown.collect()] == ["one source", "a", "a and b", "a, b and c"]
