"""Merging to the end, every reason of the chain, a run written twice, and where tables are written."""

import random

import pytest

from trendspark import session
from trendspark.operators import finals as Z
from trendspark.operators import merging as M
from trendspark.plans import finals as Q
from trendspark.sources import store as S

SF = "/root/testdata/sf0.001"


def slow_merge(drafts, linked):
    """Pairs merged one after the other until none merge, as sets of drafts."""
    drafts = [dict(d, of={d["draft_id"]}) for d in drafts]

    def pair():
        for i, a in enumerate(drafts):
            for j in range(i + 1, len(drafts)):
                b = drafts[j]
                ka, kb = set(map(str.lower, a["entities"])), set(map(str.lower, b["entities"]))
                n, half = len(ka & kb), bool(ka and kb) and 2 * len(ka & kb) >= len(ka | kb)
                if a["run_id"] == b["run_id"] and (a["headline"].lower() == b["headline"].lower() or half or n >= 2 and (ka <= kb or kb <= ka)):
                    if any((x, y) in linked or (y, x) in linked for x in a["of"] for y in b["of"]) or ka and ka == kb or half and n >= 2:
                        return i, j
        return None

    while at := pair():
        a, b = (drafts[k] for k in at)
        first, second = sorted((a, b), key=lambda d: (-d["members"], -d["relevance"]))
        names = list(dict.fromkeys([*first["entities"], *second["entities"]]))[: M.ENTITIES]
        one = dict(first, of=a["of"] | b["of"], members=a["members"] + b["members"], relevance=max(a["relevance"], b["relevance"]), entities=names)
        drafts = [d for k, d in enumerate(drafts) if k not in at] + [one]
    return sorted((sorted(d["of"]), d["members"], d["relevance"], d["headline"], d["entities"]) for d in drafts)


def test_drafts_merge_until_none_do(spark):
    rows = [
        (1, 1, 6, 5, "Tech", "Rain in York", ["York", "Rain"]),
        (1, 2, 2, 7, "News", "Storm", ["Rain", "York", "Storm"]),
        (1, 3, 5, 4, "News", "Flood", ["Storm", "York", "Rain", "Flood"]),
        (1, 4, 1, 4, "News", "Other", ["Other"]),
        (1, 5, 1, 4, "News", "other", ["Else"]),
        (2, 6, 1, 9, "News", "Rain in York", ["York", "Rain"]),
        (1, 7, 1, 1, "News", "Bare", []),
    ]
    names = ["run_id", "draft_id", "members", "relevance", "category", "headline", "entities"]
    df = spark.createDataFrame(rows, "run_id long, draft_id long, members long, relevance int, category string, headline string, entities array<string>")
    for linked in (set(), {(4, 5)}):
        links = spark.createDataFrame(sorted(linked), "left_id long, right_id long")
        now, home = M.merged(df, links)
        of = {}
        for r in home.collect():
            of.setdefault(r["root"], []).append(r["draft_id"])
        got = sorted((sorted(of[r["draft_id"]]), r["members"], r["relevance"], r["headline"], r["entities"]) for r in now.collect())
        assert got == slow_merge([dict(zip(names, r, strict=True)) for r in rows], linked)
    assert M.merged(df.where("false"))[0].collect() == []


NAMES = ["run_id", "draft_id", "members", "relevance", "category", "headline", "entities"]
DRAFTS = "run_id long, draft_id long, members long, relevance int, category string, headline string, entities array<string>"


def merged_as_sets(now, home):
    of = {}
    for r in home.collect():
        of.setdefault(r["root"], []).append(r["draft_id"])
    return sorted((sorted(of[r["draft_id"]]), r["members"], r["relevance"], r["headline"], r["entities"]) for r in now.collect())


def test_a_chain_does_not_merge_through_its_middle(spark):
    rows = [(1, 1, 3, 5, "News", "A", ["one", "two", "three"]), (1, 2, 2, 5, "News", "B", ["two", "three", "four"]), (1, 3, 2, 5, "News", "C", ["three", "four", "five"])]
    now, home = M.merged(spark.createDataFrame(rows, DRAFTS))
    assert merged_as_sets(now, home) == [([1, 2], 5, 5, "A", ["one", "two", "three", "four"]), ([3], 2, 5, "C", ["three", "four", "five"])]
    assert [r["place"] for r in now.orderBy("draft_id").collect()] == [1, 0]  # the merged draft is the last of the list


def test_random_runs_merge_as_pair_by_pair(spark):
    rng = random.Random(5)
    rows, links = [], set()
    for run in range(200):
        own = list(range(run * 100, run * 100 + rng.randint(1, 9)))
        rows += [(run, k, rng.randint(1, 4), rng.randint(1, 4), "News", f"Headline {rng.randint(0, 6)}", rng.sample("alpha beta gamma delta epsilon zeta eta2 theta".split(), rng.randint(0, 4))) for k in own]
        links |= {tuple(sorted(rng.sample(own, 2))) for _ in range(rng.randint(0, 6)) if len(own) > 1}
    frame = spark.createDataFrame(sorted(links), "left_id long, right_id long")
    got = merged_as_sets(*M.merged(spark.createDataFrame(rows, DRAFTS), frame))
    want = sorted(x for run in range(200) for x in slow_merge([dict(zip(NAMES, r, strict=True)) for r in rows if r[0] == run], links))
    assert got == want
    assert any(len(of) > 2 for of, *_ in want)


def test_odd_drafts_merge_with_nothing(spark):
    rows = [(1, 1, None, None, None, None, None), (1, 2, 1, 1, None, "", []), (1, 3, 1, 1, "News", "the", ["", "a", None]), (None, 4, 1, 1, "News", "x", ["abc"])]
    now, home = M.merged(spark.createDataFrame(rows, DRAFTS), spark.createDataFrame([(1, 2)], "left_id long, right_id long"))
    assert sorted(r["draft_id"] for r in now.collect()) == [1, 2, 3, 4]
    assert all(r["draft_id"] == r["root"] for r in home.collect())
    M.LARGEST_RUN, was = 1, M.LARGEST_RUN
    same = [(1, 1, 1, 1, "News", "Rain", []), (1, 2, 1, 1, "News", "Rain", [])]
    try:
        with pytest.raises(ValueError):
            M.merged(spark.createDataFrame(same, DRAFTS))
    finally:
        M.LARGEST_RUN = was


def test_every_reason_of_the_chain_fires(spark):
    got = [r["discard_reason"] for r in Q._chain(spark, SF).where(f"item_id < {len(Q.PLANTED)}").orderBy("item_id").collect()]
    chain = [k for k, stage in Z.L.DISCARD_STAGES.items() if stage == "clean"]
    order = ["reddit_low_signal_subreddit", "reddit_low_engagement", "reddit_unverified_metrics", "hn_low_points", "github_low_stars", "generic_hashtag", "generic_hashtag"]
    order += ["too_short_or_non_ascii", "personal_anecdote", "meme_or_photo", "pet_post", "box_score_or_betting", "no_signal_tokens"]
    assert got == order + [None] * (len(Q.PLANTED) - len(order)) and set(order) == set(chain)


def test_accounts_of_all_runs_balance(spark):
    got = Q._accounts(spark, SF).collect()
    assert got and all(r["unaccounted"] == 0 and r["clean_holds"] and r["select_holds"] and r["clustered"] > 0 for r in got)
    lines, cleaned, entries, clusters = Q._ledger(spark, SF)
    lost = Z.accounting(lines, cleaned, entries, clusters.where("cluster_id <> 0")).collect()
    assert any(r["unaccounted"] > 0 and not r["select_holds"] for r in lost)


def test_a_run_written_again_takes_the_place_of_the_first(spark, tmp_path):
    path = str(tmp_path / "history")
    run = lambda end: spark.createDataFrame([("r", 5.0, end, 2, 2, 1, "none", 1.0)], S.RUN)
    items = spark.createDataFrame([("r", "a", True, 1), ("r", "b", True, 1)], "run_id string, text_key string, kept boolean, duplicate_count int")
    clusters = spark.createDataFrame([("r", "c", "h", 1.0)], "run_id string, cluster_id string, headline string, combined_score double")
    with pytest.raises(Exception, match="nowhere"):  # fails before its row
        S.save_run(path, run(6.0), items, clusters.selectExpr("run_id", "cluster_id", "raise_error('nowhere') AS headline", "combined_score"))
    S.save_run(path, run(None), items, clusters)
    for end in (6.0, 7.0):
        S.save_run(path, run(end), items.withColumn("text_key", Z.F.concat("text_key", Z.F.lit(str(end)))), clusters)
    runs = S.finished_runs(spark, path)
    assert [r["finished_at"] for r in runs.collect()] == [7.0]
    assert sorted(r["text_key"] for r in S.of_runs(spark, path, "items", runs).collect()) == ["a7.0", "b7.0"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                nothing = type("None_", (), {"getOrElse": lambda self, x: x, "isEmpty": lambda self: True})()
                return type("Sc", (), {"getCheckpointDir": lambda self: nothing})()

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    fake = type("Session", (), {"conf": {}, "sparkContext": Context})()
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(fake)
