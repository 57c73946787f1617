"""Rules over drafts and small reports that the driver's tables seldom meet."""

import duckdb
from pyspark.sql import functions as F

from trendspark.operators import labels as V
from trendspark.operators import links as K
from trendspark.plans import topics


def test_questions(spark):
    trends = spark.createDataFrame([(1, "Packers beat Falcons in overtime", ["Packers", "Falcons"]), (2, "Storm nears Florida coast", ["Florida"]), (3, "Storm season records broken", ["NOAA"])], "rank int, headline string, entities array<string>")
    asked = ["tell me about #3 and trend 1", "trend 9?", "what of the packers", "the storm season records", "is florida safe, Packers?", "", None]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "question_id int, question string")
    got = V.question_matches(q.withColumn("question", F.coalesce("question", F.lit(""))), trends).orderBy("question_id", "nth").collect()
    assert [(r.question_id, r.rank) for r in got] == [(0, 3), (0, 1), (2, 1), (3, 3), (4, 2), (4, 1)]


def test_tickets(spark):
    rows = [("a", "todo", None, None, "low", "2"), ("b", "in_progress", True, "me", None, "9"), ("c", "todo", False, None, "critical", "1"), ("d", "todo", True, "other", "high", "1"), ("e", "todo", True, None, "critical", "3"), ("f", "done", True, None, "high", "1"), ("g", "todo", True, None, "odd", "1")]
    df = spark.createDataFrame(rows, "ticket_id string, status string, dependency_ready boolean, active_run string, priority string, updated_at string")
    assert [r.ticket_id for r in V.claimable_tickets(df, "me").collect()] == ["b", "e", "g", "a"]


def test_guards(spark):
    rows = [(1, 1, "arxiv", None, "game"), (2, 2, "reddit", None, "game on"), (3, 3, "reddit", None, "none"), (4, 4, "reddit", "Tech", "game"), (5, 5, "reddit", None, "chip chip"), (6, 6, "reddit", None, "nothing"), (6, 7, "reddit", "News", "nothing")]
    m = spark.createDataFrame(rows, "draft_id int, item_id int, source string, hint string, title string")
    voted = V.category_votes(m, {"Sports": r"\bgame\b", "Tech": r"\bchip\b"})
    proposed = spark.createDataFrame([(1, "Sports"), (2, "Tech"), (3, "Science & AI"), (4, "Tech"), (5, "Sports"), (6, "Tech")], "draft_id int, proposed string")
    assert {r.draft_id: r.category for r in V.guarded_category(proposed, voted).collect()} == {1: "Science & AI", 2: "Sports", 3: "News", 4: "Tech", 5: "Tech", 6: "News"}
    assert [r.inferred for r in voted.orderBy("item_id").collect()] == ["Sports", "Sports", None, "Sports", "Tech", None, None]


def test_headline_stands_for_names(spark):
    clusters = spark.createDataFrame([(1, "NFL: Packers"), (2, "Storm")], "cluster_id int, headline string")
    names = spark.createDataFrame([(2, "Florida")], "cluster_id int, entity string")
    assert {tuple(r) for r in V.with_headline_entity(clusters, names).collect()} == {(1, "Packers"), (2, "Florida")}


def test_newest_snapshot(spark):
    runs = lambda *at: spark.createDataFrame([(f"r{a}", float(a)) for a in at], "run_id string, started_at double")
    pick = lambda a, b: V.newest_snapshot(a, b).collect()
    assert pick(runs(1, 3), runs(3, 2))[0].is_cloud and not pick(runs(4), runs(3))[0].is_cloud and pick(runs(), runs()) == []


def test_draft_falls_apart(spark):
    titles = ["packers falcons overtime thriller", "packers falcons overtime", "zebra quilt", "lonely violin"]
    m = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(titles)], "draft_id int, item_id int, title string, text_key string")
    e = spark.createDataFrame([(1, "packers"), (1, "unseen"), (1, "falcons")], "draft_id int, entity_key string")
    parts = K.coherence(K.draft_components(m, e)).orderBy("item_id").collect()
    assert [r.outcome for r in parts] == ["kept", "kept", "orphan", "orphan"] and [r.relabel for r in parts] == [True, True, False, False]
    assert {r.entity_key for r in K.grounded(m, e).collect()} == {"packers", "falcons"}
    orphans = spark.createDataFrame([(9, "falcons lost again"), (8, "nothing")], "item_id int, text_key string")
    assert [tuple(r) for r in K.rehomed(orphans, e).collect()] == [(9, 1)]
    links = K.linked(K.shared_tokens(m, within="draft_id"))
    proposed = spark.createDataFrame([(1, 1), (2, 1), (9, 1)], "item_id int, draft_id int")
    named = K.mentions(orphans, e)
    core = m.where("item_id = 0")
    assert {r.item_id for r in K.supported(proposed, links, core, e, named).collect()} == {1, 9}
    assert K.lexical_groups(m.limit(0)).collect() == []


def test_halves_of_scores_go_up_in_sql_too(spark, tmp_path):
    """3329 / 20000 is 0.16645, a half, by which the first title leads; the SQL rounded its binary value down."""
    long = "Of ingtionly the to then enatin inre hetionon inen erbleat athaes hehaly."
    rows = [(0, "Ouwhea the of rend and threlyes ofthstthor ouble edoution wh onharent", "src1", 3329), (1, long, "src2", 2530)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [tuple(r) for r in topics.queries()["best_member_title"](spark, str(tmp_path)).select("draft_id", "title").collect()]
    assert got == con.execute(f"SELECT draft_id, title FROM ({topics.oracle_sql()['best_member_title']})").fetchall()
