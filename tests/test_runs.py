"""Packs, proposals in order, labels by a provider, stages that go on, and a whole run that balances."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trendspark.operators import finals as Z
from trendspark.operators import labelling as B
from trendspark.operators import links as K
from trendspark.operators import runs as R
from trendspark.operators import stages as ST
from trendspark.plans import runs as Q
from trendspark.plans import topics

SF = "/root/testdata/sf0.001"
PROPOSALS, ITEMS = "run_id long, at long, item_id long, draft_id long", "item_id long, title string, text_key string"


def test_packs_as_by_a_loop(spark):
    rng = random.Random(8)
    rows = [(run, 100 * run + k, k % 7, rng.choice([1, 2, 3, 4, 9, 30])) for run in range(20) for k in range(rng.randint(1, 30))]
    want = set()
    for run in range(20):
        pack, used, nth = 0, 0, 0
        for _, draft, _, n in sorted((r for r in rows if r[0] == run), key=lambda r: (-r[3], r[2], r[1])):
            shown = min(n, 4)
            pack, used, nth = (pack + 1, shown, 1) if not pack or used + shown > 20 else (pack, used + shown, nth + 1)
            want.add((run, draft, pack, nth))
    got = B.packed(spark.createDataFrame(rows, "run_id long, draft_id long, place long, members long")).collect()
    assert {(r["run_id"], r["draft_id"], r["pack"], r["nth"]) for r in got} == want
    assert B.packed(spark.createDataFrame([], "run_id long, draft_id long, place long, members long")).collect() == []


def frames(spark, proposals, members, items, entities, links):
    return (
        spark.createDataFrame(proposals, PROPOSALS), spark.createDataFrame(members, "draft_id long, item_id long"), spark.createDataFrame([(i, t, t.lower()) for i, t in items], ITEMS),
        spark.createDataFrame(entities, "draft_id long, entity_key string"), spark.createDataFrame(links, "left_id long, right_id long"),
    )


def outcomes(*given):
    return [(r["at"], r["item_id"], r["draft_id"], r["outcome"]) for r in B.taken_in(*given).orderBy("run_id", "at").collect()]


def test_what_was_taken_in_counts_for_later_proposals(spark):
    items = [(1, "Bridge opens"), (2, "Bridge toll"), (3, "Toll rises"), (4, "Nothing here"), (5, "Quake near Lima"), (6, "Lima airport shut"), (7, "shut airport lima coast"), (8, "old coast")]
    # 2 links to the member 1, 3 to 2 only; 4 to nothing. 7 comes before what it links to.
    proposals = [(1, 1, 3, 10), (1, 2, 2, 10), (1, 3, 3, 10), (1, 4, 4, 10), (1, 5, 3, 20), (1, 6, 7, 10)]
    got = outcomes(*frames(spark, proposals, [(10, 1), (20, 5)], items, [(20, "lima")], [(1, 2), (3, 2), (6, 7)]))
    assert got == [(1, 3, 10, "rejected"), (2, 2, 10, "accepted"), (3, 3, 10, "accepted"), (4, 4, 10, "rejected"), (5, 3, 20, "taken"), (6, 7, 10, "rejected")]
    # An entity that no member names supports a proposal once one that names it is a member, or all its tokens are members'.
    got = outcomes(*frames(spark, [(1, 1, 6, 20), (1, 2, 8, 30), (1, 3, 7, 30), (1, 4, 8, 30)], [(20, 1), (30, 1)], items, [(20, "lima airport"), (30, "airport coast"), (30, "old coast")], [(1, 6), (7, 1)]))
    assert got == [(1, 6, 20, "accepted"), (2, 8, 30, "rejected"), (3, 7, 30, "accepted"), (4, 8, 30, "accepted")]


def test_odd_proposals(spark):
    items = [(1, "Bridge opens"), (2, "Bridge toll")]
    assert outcomes(*frames(spark, [], [(1, 1)], items, [], [])) == []
    assert outcomes(*frames(spark, [(1, 1, 2, 99), (2, 1, 2, 10), (2, 2, 77, 10)], [(10, 1), (10, 1)], items, [(10, ""), (10, "abc")], [(2, 1), (1, 2)])) == [(1, 2, 99, "rejected"), (1, 2, 10, "accepted"), (2, 77, 10, "rejected")]


def answers(prompts):
    """Labels group 1, has no headline for group 2, a late second label of 3; every offer to group 1; one void answer."""
    out = []
    for p in prompts:
        groups = [{"group_id": "1", "headline": "First", "category": "Tech", "primary_entities": ["Bridge", " ", "Toll"], "summary": "It is so.", "relevance_score": "99"}, {"group_id": 2, "headline": " "}, {"group_id": 3, "headline": "Old"}, {"group_id": 3, "headline": "New", "relevance_score": "x"}]
        homes = [{"item_id": k, "group_id": 1} for k in range(0, 9)]
        out.append("no json" if "Void" in p else None if "Fails" in p else json.dumps({"groups": groups + ([{"headline": "no id"}] if "Numberless" in p else []), "assignments": homes}))
    return out


def plain_labels(members):
    return members.groupBy("draft_id").agg(F.lit("Plain").alias("headline"), F.lit("News").alias("category"), F.array().cast("array<string>").alias("entities"), F.lit("s").alias("summary"), F.lit(2).alias("relevance"))


def relabelled(spark, titles, orphans, links, provider=answers):
    """titles: (run, draft, item, title, needs_label)."""
    drafts = [(run, d, d, need, "was", "News", ["Was"], "old", 5) for run, d, need in sorted({(r, d, n) for r, d, _, _, n in titles})]
    df = spark.createDataFrame(drafts, "run_id long, draft_id long, place long, needs_label boolean, headline string, category string, entities array<string>, summary string, relevance int")
    members = spark.createDataFrame([(d, i, i) for _, d, i, _, _ in titles], "draft_id long, item_id long, place long")
    items = spark.createDataFrame([(i, t, t.lower(), f"src | - | {t} | c") for _, _, i, t, _ in titles] + [(i, t, t.lower(), f"src | - | {t} | c") for _, i, t in orphans], ITEMS + ", line string")
    free = spark.createDataFrame([(r, i, i) for r, i, _ in orphans], "run_id long, item_id long, nth long")
    return B.relabel(df, members, free, items, spark.createDataFrame(links, "left_id long, right_id long"), provider, plain_labels)


def test_labels_homes_and_counts(spark):
    titles = [(1, d, 10 * d + k, f"Title {d} {k}", d != 4) for d in (1, 2, 3, 4) for k in range(4 - d % 3)] + [(2, 5, 50, "Void", True), (3, 6, 60, "Fails", True), (4, 7, 70, "Numberless", True)]
    orphans = [(1, 91, "Near"), (1, 92, "Far"), (1, 93, "Nearer"), (2, 94, "Alone")]
    # Drafts of run 1 by size: 3 (4 members), 1 (3), 2 (2): group 1 is draft 3.
    out = relabelled(spark, titles, orphans, [(30, 91), (91, 93), (50, 94)])
    got = {r["draft_id"]: (r["headline"], r["relevance"], r["entities"], r["needs_label"]) for r in out.drafts.collect()}
    assert got == {3: ("First", 10, ["Bridge", "Toll"], False), 1: ("Plain", 2, [], False), 2: ("New", 5, [], False), 4: ("was", 5, ["Was"], False), 5: ("Plain", 2, [], False), 6: ("Plain", 2, [], False), 7: ("Plain", 2, [], False)}
    assert sorted((r["draft_id"], r["item_id"]) for r in out.members.where("item_id > 90").collect()) == [(3, 91), (3, 93)]
    assert [r["item_id"] for r in out.members.where("draft_id = 3").orderBy("place").collect()][-2:] == [91, 93]
    assert sorted(r["item_id"] for r in out.orphans.collect()) == [92, 94]
    assert {(r["run_id"], r["what"]): r["n"] for r in out.counts.collect()} == {(1, "labelled"): 2, (1, "heuristic"): 1, (1, "accepted"): 2, (1, "rejected"): 1, (2, "heuristic"): 1, (3, "heuristic"): 1, (4, "heuristic"): 1}


def test_an_orphan_is_offered_until_it_is_taken_in(spark):
    """Two packs of six drafts: what the first takes in is not offered to the second."""
    titles = [(1, d, 10 * d + k, f"Title {d}", True) for d in range(1, 7) for k in range(4)]
    out = relabelled(spark, titles, [(1, 91, "Near"), (1, 92, "Far")], [(10, 91), (60, 92)])
    assert sorted((r["draft_id"], r["item_id"]) for r in out.members.where("item_id > 90").collect()) == [(1, 91), (6, 92)]
    assert out.orphans.collect() == []
    with pytest.raises(Exception, match="answers to"):
        relabelled(spark, titles, [], [], lambda prompts: [])
    none = relabelled(spark, [(1, 1, 1, "x", False)], [(1, 2, "y")], [])
    assert none.counts.collect() == [] and [r["headline"] for r in none.drafts.collect()] == ["was"]


class Stopped(Exception):
    pass


def test_a_job_goes_on_from_its_last_stage(spark, tmp_path):
    names, source = ["a", "b", "c", "d"], spark.range(5)

    def job(stop, rows=source):
        stages, now, made = ST.Stages(spark, str(tmp_path), rows), rows, []
        for k, name in enumerate(names):
            def make(now=now, name=name):
                if len(made) == stop:
                    raise Stopped
                made.append(name)
                return now.select((F.col("id") + 1).alias("id"))
            now = stages(name, make)
        return made, sorted(r["id"] for r in now.collect())

    for _ in names[:-1]:  # each attempt makes one stage and stops at the next
        with pytest.raises(Stopped):
            job(1)
    assert job(1)[0] == ["d"]
    assert job(0) == ([], [4, 5, 6, 7, 8])
    assert job(9, spark.range(6)) == (names, [4, 5, 6, 7, 8, 9])  # another input
    assert ST.fingerprint(spark.range(9)) == ST.fingerprint(spark.range(9).repartition(4)) != ST.fingerprint(spark.range(9).union(spark.range(1)))


TITLES = [
    (1, "reddit", "Packers beat Falcons in Atlanta", 0.9, "The Packers won the match. More follows."), (2, "x_trends24", "Falcons lose to Packers at home", 0.7, None), (3, "google_news", "Packers Falcons match report", 0.6, "A report of the match."),
    (4, "hackernews", "Compiler release brings faster loops", 0.8, "The compiler was released on Monday."), (5, "github", "Compiler release with faster loops", 0.5, None), (6, "tiktok", "Unrelated dance", 0.95, "A dance."), (7, "arxiv", "Sparse attention", 0.3, None),
]


def candidates(spark):
    rows = [(i, s, t, t, v, f"https://e.org/{i}", None, None, None, c, 1, f"{s} | - | {t} | {c}") for i, s, t, v, c in TITLES]
    return spark.createDataFrame(rows, "item_id long, source string, title string, told string, score double, url string, hint string, inferred string, description string, context string, duplicate_count long, line string")


@pytest.mark.parametrize("provider", [None, Q.short_answers])
def test_candidates_are_in_one_cluster_or_have_one_reason(spark, provider):
    items = candidates(spark)
    out = R.cluster(items, items, {"Sports": "match|beat", "Tech": "compiler"}, ST.Stages(spark), provider=provider, keep_top=provider is None)
    held, gone = sorted(r["item_id"] for r in out.members.collect()), sorted((r["item_id"], r["reason"]) for r in out.discards.collect())
    assert sorted([*held, *(i for i, _ in gone)]) == [i for i, *_ in TITLES]
    got = {r["headline"]: r for r in out.clusters.collect()}
    if provider is None:
        assert [i for i, r in gone] == [7] and len(got) == 3
        packers = next(r for h, r in got.items() if "Packers" in h)
        assert (packers["category"], packers["members"], packers["raw_items"], packers["sources"]) == ("Sports", 3, 3, "google_news,reddit,x_trends24")
        assert packers["summary"].startswith("The Packers won the match.") and "Packers" in packers["entities"]
    assert sum(r["members"] for r in got.values()) == len(held)


def test_a_whole_run_balances_and_goes_on(spark, tmp_path, monkeypatch):
    call, made = ST.Stages.__call__, []

    def some(self, stage, make):
        if len(self.made) >= 7:
            raise Stopped
        made.append(stage)
        return call(self, stage, make)

    monkeypatch.setattr(ST.Stages, "__call__", some)
    for _ in range(9):
        try:
            found, ledger = Q.whole_run(spark, SF, str(tmp_path))
            break
        except Stopped:
            continue
    (row,) = ledger.collect()
    assert (row["unaccounted"], row["clean_holds"], row["select_holds"]) == (0, True, True) and row["clustered"] > 0
    assert made.count("raw") >= 3  # as often as the job began
    assert sum(r["raw_items"] for r in found.clusters.collect()) == row["clustered"]
    # A cluster that is lost is missed.
    raw = spark.range(row["ingested"]).select(F.lit(0).alias("run_id"))
    weights = spark.createDataFrame([(0, 1, row["passed"])], "run_id int, item_id long, weight long")
    entries = spark.createDataFrame([(0, "clean", "x", row["discarded"])], "run_id int, stage string, reason string, n long")
    lost = Z.accounting(raw, weights, entries, found.clusters.limit(1).select(F.lit(0).alias("run_id"), "raw_items")).first()
    assert lost["unaccounted"] == row["clustered"] - found.clusters.limit(1).first()["raw_items"] or found.clusters.count() == 1


def test_links_count_the_items_of_a_run_and_meet_in_blocks(spark, monkeypatch):
    rows = [(i, i % 2, f"common{i % 40} shared{i // 2 % 11} word{i}") for i in range(1500)]
    items = spark.createDataFrame(rows, "item_id long, run long, title string")
    monkeypatch.setattr(K, "DEALT", 7)
    got = {(r["left_id"], r["right_id"]): (r["shared"], r["rare"]) for r in K.shared_tokens(items, run="run").collect()}
    want = {}
    for run in (0, 1):
        own = [(i, set(t.split())) for i, r, t in rows if r == run]
        df = {}
        for _, t in own:
            for x in t:
                df[x] = df.get(x, 0) + 1
        rare, join = max(4, int(0.06 * len(own))), max(6, int(0.10 * len(own)), 12)
        for k, (i, a) in enumerate(own):
            for j, b in own[k + 1 :]:
                if any(df[x] <= join for x in a & b):
                    want[i, j] = (len(a & b), sum(df[x] <= rare for x in a & b if df[x] <= join))
    assert got == want and max(n for n, _ in got.values()) == 2


def test_heuristic_drafts_of_odd_members(spark):
    members = candidates(spark).select(F.lit(1).alias("draft_id"), "item_id", "source", F.lit("x").alias("title"), "score", "hint", F.lit(None).cast("string").alias("context"), F.lit(None).cast("long").alias("duplicate_count")).limit(1)
    (r,) = R.heuristic_drafts(members, topics.PATTERNS).collect()
    assert (r["headline"], r["category"], r["entities"], r["summary"]) == ("X", "News", [], "[INSUFFICIENT_DATA]")
    assert R.heuristic_drafts(members.where("false"), topics.PATTERNS).collect() == []
