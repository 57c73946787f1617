"""Headlines, summaries and model answers on texts written for them."""

import json

from pyspark.sql import functions as F

from trendspark.functions import prose as P


def each(spark, make, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_headlines(spark):
    texts = {
        "tech: the new gpt-6 beats iPhone and NFL of old": "The New GPT-6 Beats iPhone and NFL of Old",
        "[Read this](https://a.org/x) by @bob on example.com": "Read This by on",
        "one two three four five six seven eight in ten eleven": "One Two Three Four Five Six Seven Eight",
        "one two three four five six seven eight nine of ten": "One Two Three Four Five Six Seven Eight Nine",
        "win: a day for \"the\" team": "Win: A Day for \"The\" Team",
        "": "",
    }
    assert each(spark, P.sanitize_headline, [*texts, None]) == [*texts.values(), ""]


def test_summaries(spark):
    texts = {
        "the packers won on monday ,, see https://a.org/b.": "The packers won on Monday, see.",
        json.dumps({"x": 1, "summary": "It rained"}): "It rained.",
        json.dumps({"a": "short", "b": "the longer one"}): "The longer one.",
        json.dumps(["first part.", "second part"]): "First part. Second part.",
        "{not json": "Not json.",
        "@hackernews says hello . ok": "Hackernews says hello.",
        "": "",
    }
    assert each(spark, P.sanitize_summary, [*texts, None]) == [*texts.values(), ""]
    named = lambda t: P.sanitize_summary(t, F.array(F.lit("Green Bay"), F.lit("C$ Co")))
    assert each(spark, named, ["a green bay win for c$ co today"]) == ["A Green Bay win for C$ Co today."]
    two = lambda t: P.two_sentences(t, F.array(F.lit("reddit"), F.lit("github")), F.lit("Rain."))
    assert each(spark, two, ["One here. Two here. Three here.", "One here", None]) == ["One here. Two here.", "One here. The story is trending across Reddit and GitHub at the same time.", "Rain is drawing attention across trend sources. The story is trending across Reddit and GitHub at the same time."]


def test_insufficient(spark):
    flags = each(spark, lambda t: P.is_insufficient(t, F.lit("A headline")), ["[INSUFFICIENT_DATA]", "Details remain unclear to all.", "It rained.", "", None])
    assert flags == [True, True, False, True, True]


def test_names(spark):
    assert each(spark, P.proper_nouns, ["The Packers beat Bank of America while TDs rain", "New York", "no name", ""]) == [["Packers", "Bank of America"], ["York"], [], []]
    df = spark.createDataFrame([(["green bay", "Green Bay", "green bay", "the", "GPT 6 model of the very old days"],)], "e array<string>")
    assert df.select(P.clean_entities(F.col("e"))).first()[0] == ["Green Bay", "GPT 6 Model"]


def test_titles_are_rewritten(spark):
    df = spark.createDataFrame([("tiktok", "#JordanLove"), ("reddit", "BREAKING: Storm hits [OC]"), ("reddit", None), ("reddit", "word " * 100)], "s string, t string")
    got = [r[0] for r in df.select(P.rewritten_title(F.col("s"), F.col("t"))).collect()]
    assert got[:3] == ["Jordan Love", "Storm hits", ""] and got[3].endswith("word...") and len(got[3]) <= 350


def test_texts_for_models(spark):
    news = F.array(F.lit("N1"), F.lit("N2"), F.lit("N3"), F.lit("N4"))
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        P.item_text(F.lit("google_trends"), F.lit("T"), F.lit("D"), news), P.item_text(F.lit("reddit"), F.lit("T"), F.lit("D"), news), P.item_text(F.lit("github"), F.lit("T"), F.lit("D"), news),
        P.embedding_text(F.lit("T"), F.lit("C")), P.prompt_line(F.lit("reddit"), F.lit("nfl"), none, F.lit("Big win"), F.lit("Big Win - it was"), news, none), P.prompt_line(F.lit("google_trends"), none, F.lit("Tech"), F.lit("T"), none, news, none), P.prompt_line(F.lit("github"), none, none, F.lit("T"), none, news, none),
    ).first()
    assert tuple(row) == ("T N1 N2 N3", "T D", "T", "clustering: T. C", "reddit/r/nfl | - | Big win | it was", "google_trends | Tech | T | N1 / N2", "github | - | T | (no context)")


def test_answers(spark):
    texts = ['```json\n{"a": 1}\n```', 'so: {"a": 1} ok', '{"a": [1, 2,],}', '[{"a": 1}]', "none", "7", None]
    assert each(spark, lambda t: F.to_json(P.extract_json(t)), texts) == ['{"a":1}', '{"a":1}', '{"a":[1,2]}', '{"clusters":[{"a":1}]}', None, None, None]


def test_prose_in_json_is_its_strings(spark):
    texts = {
        '{"a": 123456789, "b": "hi", "c": {"text": "much longer than hi"}, "d": ["no", "no, not this"], "e": true}': "hi", '{"summary": 12, "text": "told", "a": "longer than told"}': "told", '{"a": "one", "b": "two", "c": "three"}': "three",
        '["one", 2, "three", ["four"], null]': "one three", '{"a": {"b": "deep"}}': "", "[]": "", "{}": "", '{"broken": ': '{"broken": ', "7": "7", '"quoted"': '"quoted"', "plain": "plain", ' {"headline": "H"} ': "H", "": "",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", P.json_prose(F.col("t")).alias("p")).collect()} == texts
    assert spark.range(1).select(P.json_prose(F.lit(None).cast("string"))).first()[0] is None


def test_columns_are_worked_out_once(spark):
    """A column that is written several times, or in a lambda, is evaluated as often; before, two_sentences wrote its summary 450 times."""
    df = spark.createDataFrame([("a", ["b"])], "told string, names array<string>")
    made = {
        "two": P.two_sentences(F.col("told"), F.col("names"), F.lit("x")), "headline": P.sanitize_headline(F.col("told")), "summary": P.sanitize_summary(F.col("told")),
        "entities": P.clean_entities(F.col("names")), "answer": P.extract_json(F.col("told")).cast("string"),
    }
    for name, column in made.items():
        plan = df.select(column.alias("made"))._jdf.queryExecution().analyzed().expressions().mkString()
        used = "names#" if name == "entities" else "told#"
        assert plan.count(used) <= 1, name
