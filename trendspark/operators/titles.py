"""Rules on titles that name a reason to discard an item, the first that fires first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.functions import normalize as N


def title_reason(df: DataFrame) -> DataFrame:
    """df with the normal title and the reason of the first title rule that fires; null where none does."""
    df = df.withColumn("clean_title", N.normalize_text(F.col("title")))
    source, title = F.col("source"), F.col("clean_title")
    tag = F.lower(F.regexp_replace(title, "[# ]", ""))
    generic = tag.isin(*L.GENERIC_HASHTAGS) | tag.rlike(f"^(?:{L.GENERIC_HASHTAG})$")
    reason = (
        F.when(source.isin("tiktok", "x_trends24") & generic, "generic_hashtag")
        .when(source.isin(*L.ANECDOTE_SOURCES) & title.rlike("(?i)" + L.ANECDOTE), "personal_anecdote")
        .when(source.isin(*L.SOCIAL) & title.rlike("(?i)" + L.MEME_PHOTO), "meme_or_photo")
        .when(source.isin(*L.SOCIAL) & title.rlike("(?i)" + L.PET), "pet_post")
        .when(~source.isin(*L.NO_BOX_SCORE_SOURCES) & title.rlike("(?i)" + L.BOX_SCORE), "box_score_or_betting")
    )
    return df.withColumn("title_reason", reason)


def reddit_reason(df: DataFrame, greatest_rank: int = 10) -> DataFrame:
    """df (source, subreddit, metrics_verified, rank) with the reason for which a post is discarded by its feed."""
    reason = F.when(F.lower("subreddit").isin(*L.LOW_SIGNAL_SUBREDDITS), "reddit_low_signal_subreddit").when(~F.coalesce("metrics_verified", F.lit(False)) & (F.col("rank").isNull() | (F.col("rank") > greatest_rank)), "reddit_unverified_metrics")
    return df.withColumn("reddit_reason", F.when(F.col("source") == "reddit", reason))
