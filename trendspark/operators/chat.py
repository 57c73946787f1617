"""A turn of a chat about a report, as data: what is asked, which trends it is about, what is read, what a model is told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.operators import labels as V
from trendspark.operators import pages as P
from trendspark.session import materialize

TURNS, MESSAGE_CHARS, TRENDS = 2, 4000, 2


def history(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, turn, role, text) of the last 2 x turns + 1 messages of users and assistants that say something, cut in length."""
    said = messages.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return said.withColumn("back", back).where(F.col("back") <= 2 * turns + 1).select("conv_id", "turn", "role", F.substring("text", 1, MESSAGE_CHARS).alias("text"), "back")


def turns(messages: DataFrame, trends: DataFrame, cache: DataFrame, report: DataFrame, rules: str = "", keep: int = TURNS) -> DataFrame:
    """(conv_id, outcome, question, ranks, to_read, told, messages) of each conversation.

    messages: conv_id, turn, role, text; trends, of one report: rank, headline, entities, source_urls; cache: url, text of
    pages read before (empty for one that says nothing); report: one row, text. outcome is `ask`, or `no question` where
    the last message that says something is no user's: then nothing else is told. ranks are the trends the question is
    about, at most TRENDS; to_read their addresses that the cache lacks, each once; told the rules, the report and the
    excerpts of pages at hand; messages the history as (role, content). A conversation that says nothing has no row.
    """
    past = materialize(history(messages, keep), "chat-history")
    rolled = past.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))  # a few messages
    last = F.element_at("m", -1)
    rolled = rolled.select("conv_id", (last["role"] == "user").alias("asks"), last["content"].alias("question"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    rolled = materialize(rolled, "chat-questions")
    found = V.question_matches(rolled.where("asks").select(F.col("conv_id").alias("question_id"), "question"), trends.select("rank", "headline", "entities"), TRENDS)
    found = materialize(found.select(F.col("question_id").alias("conv_id"), "rank", "nth"), "chat-trends")
    wanted = materialize(P.deep_reads(trends.select("rank", "headline", "source_urls")), "chat-pages")
    asked = found.select("conv_id", "rank", F.col("nth").alias("at")).join(wanted, "rank").join(cache.select("url", "text"), "url", "left")
    told = F.struct("at", "nth", "rank", "url", "text")
    pages = asked.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("text") != "", told))).alias("read"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNull(), told))), lambda p: p["url"])).alias("to_read"),
    )
    ranks = found.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "rank"))), lambda r: r["rank"]).alias("ranks"))
    all_of = rolled.join(ranks, "conv_id", "left").join(pages, "conv_id", "left").join(F.broadcast(report.select(F.col("text").alias("report"))), how="left")  # one row
    lines = F.transform("read", lambda p: F.concat(F.lit("[#"), p["rank"].cast("string"), F.lit("] "), p["url"], F.lit("\n"), p["text"]))
    excerpts = F.when(F.size("read") > 0, F.concat(F.lit("\n\nEXCERPTS:\n"), F.array_join(lines, "\n")))
    system = F.concat(F.lit(rules), F.lit("\n\n"), F.coalesce("report", F.lit("")), F.coalesce(excerpts, F.lit("")))
    outcome = F.when(F.col("asks"), "ask").otherwise("no question")
    asks = lambda c: F.when(F.col("asks"), c)
    none = lambda c, kind: asks(F.coalesce(c, F.array().cast(kind)))
    return all_of.select("conv_id", outcome.alias("outcome"), asks(F.col("question")).alias("question"), none("ranks", "array<int>").alias("ranks"), none("to_read", "array<string>").alias("to_read"), asks(system).alias("told"), "messages")
