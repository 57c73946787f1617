"""Drafts of a run that tell one story become one, pair by pair in the order of the run's list.

A merged draft has new entity keys and goes to the end of the list, so which pairs merge depends on the order; no closure
over pairs gives the same groups. The pairs of a run's first list are found by equi-joins on keys and headlines. Only runs
that have such a pair go through the loop, each in one task: a run's drafts are bounded by its budget, and LARGEST_RUN
drafts of a run are an error, never a cut. The loop keeps all pairs that merge in a heap by their places and looks at a
new draft's neighbours alone, so it takes as many steps as there are pairs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.functions import text as X
from trendspark.session import materialize

ENTITIES, LEAST_KEY, LARGEST_RUN = 6, 3, 50_000


def entity_keys(entities: Column) -> Column:
    keys = F.transform(entities, X.dedupe_key)
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= LEAST_KEY))


def mergeable(drafts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id): drafts (run_id, draft_id, headline, entities) of one run that tell one story.

    They have the same headline key, or half of all their entity keys in common, or two and all of one side's. Of these pairs
    only those count that `links` (left_id, right_id) joins, or whose keys are the same, or two and half of all. Drafts
    meet by key within a run, whose budget bounds them.
    """
    keyed = drafts.select("run_id", "draft_id", X.dedupe_key(F.col("headline")).alias("head"), entity_keys(F.col("entities")).alias("keys"))
    each = keyed.select("run_id", "draft_id", F.size("keys").alias("size"), F.explode("keys").alias("key"))
    a, b = each.alias("a"), each.alias("b")
    on = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.draft_id") < F.col("b.draft_id"))
    pair = [F.col("a.draft_id").alias("left_id"), F.col("b.draft_id").alias("right_id")]
    shared = a.join(b, on & (F.col("a.key") == F.col("b.key"))).groupBy(*pair)
    shared = shared.agg(F.count("*").alias("shared"), F.first("a.size").alias("sa"), F.first("b.size").alias("sb"))
    a, b = keyed.where("head <> ''").alias("a"), keyed.alias("b")
    same = a.join(b, on & (F.col("a.head") == F.col("b.head"))).select(*pair, F.lit(True).alias("same"))
    both = shared.join(same, ["left_id", "right_id"], "full")
    n, total = F.coalesce("shared", F.lit(0)), F.coalesce(F.col("sa") + F.col("sb") - F.col("shared"), F.lit(1))
    half = n * 2 >= total
    alike = F.coalesce("same", F.lit(False)) | half | ((n >= 2) & (n == F.least("sa", "sb")))
    both = both.where(alike).withColumn("strict", F.coalesce((n == F.col("sa")) & (n == F.col("sb")), F.lit(False)) | (half & (n >= 2)))
    if links is not None:
        ends = links.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
        both = both.join(ends.withColumn("linked", F.lit(True)), ["left_id", "right_id"], "left").where(F.col("strict") | F.coalesce("linked", F.lit(False)))
    return both.select("left_id", "right_id")


class _Draft:
    """A draft of the list: what is said of it, the drafts in it and those that its members link to."""

    def __init__(self, row: dict, near: set[int]) -> None:
        self.row, self.of, self.near = row, [row["draft_id"]], near
        self.named = [(n["entity"], n["key"]) for n in row["named"] or ()]
        self.head, self.relevance, self.members = row["head"], row["relevance"], row["members"]
        self.keys = {k for _, k in self.named if len(k) >= LEAST_KEY}

    def tells_same(self, other: _Draft, gated: bool) -> bool:
        n, total = len(self.keys & other.keys), len(self.keys | other.keys)
        half = n > 0 and 2 * n >= total
        if not (self.head and self.head == other.head or half or n >= 2 and n == min(len(self.keys), len(other.keys))):
            return False
        return not gated or half and n >= 2 or bool(self.keys) and n == total or not self.near.isdisjoint(other.of)

    def joined(self, other: _Draft) -> _Draft:
        """Both as one: what is said of it is that of the larger, then the more relevant, then the earlier one."""
        lead, rest = (other, self) if (other.members, other.relevance) > (self.members, self.relevance) else (self, other)
        out = _Draft.__new__(_Draft)
        out.row, out.head = lead.row, lead.head
        out.of, out.near = lead.of + rest.of, lead.near | rest.near
        out.members, out.relevance = lead.members + rest.members, max(lead.relevance, rest.relevance)
        first: dict[str, str] = {}
        for e, k in lead.named + rest.named:
            if k:
                first.setdefault(k, e)
        out.named = [(e, k) for k, e in first.items()][:ENTITIES]
        out.keys = {k for _, k in out.named if len(k) >= LEAST_KEY}
        return out


def agglomerate(drafts: list[_Draft], gated: bool) -> list[_Draft]:
    """The list after its first pair that merges has become one draft at its end, again and again until none merges."""
    live: dict[int, _Draft] = {}
    holders: dict[tuple[str, str], set[int]] = defaultdict(set)
    pairs: list[tuple[int, int]] = []

    def marks(d: _Draft) -> list[tuple[str, str]]:
        return [("key", k) for k in d.keys] + [("head", d.head)] * bool(d.head)

    def enter(place: int, d: _Draft) -> None:
        for other in set().union(*(holders[m] for m in marks(d))):
            if live[other].tells_same(d, gated):
                heapq.heappush(pairs, (other, place))
        live[place] = d
        for m in marks(d):
            holders[m].add(place)

    for place, d in enumerate(drafts):
        enter(place, d)
    end = len(drafts)
    while pairs:
        i, j = heapq.heappop(pairs)
        if i in live and j in live:
            a, b = live.pop(i), live.pop(j)
            for place, d in ((i, a), (j, b)):
                for m in marks(d):
                    holders[m].discard(place)
            enter(end, a.joined(b))
            end += 1
    return [live[k] for k in sorted(live)]


_SAID = ("members", "relevance", "category", "headline")
_OUT = "run_id {run}, draft_id long, place int, members long, relevance int, category string, headline string, entities array<string>, lead_id long, parts array<long>"


def merged(drafts: DataFrame, links: DataFrame | None = None, order: str = "draft_id") -> tuple[DataFrame, DataFrame]:
    """The drafts merged until none merge any more, and (draft_id, root) of all that came in.

    drafts: run_id, draft_id, members, relevance, category, headline, entities; the list of a run is in the order of
    `order`. A merged draft has the smallest draft_id of its parts, the members of all, the greatest relevance, the first
    ENTITIES distinct entities of its lead and the other, and otherwise what its lead says. place is the draft's place in
    the run's last list, lead_id the draft that speaks for it. Null headlines and entities merge with nothing; null members and relevance count as none.
    """
    key = X.dedupe_key(F.coalesce("headline", F.lit(""))).alias("head")
    named = F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.struct(e.alias("entity"), F.coalesce(X.dedupe_key(e), F.lit("")).alias("key")))
    said = [F.coalesce(F.col(c), F.lit(0)).cast("long" if c == "members" else "int").alias(c) if c in ("members", "relevance") else F.col(c) for c in _SAID]
    df = materialize(drafts.select("run_id", F.col("draft_id").cast("long").alias("draft_id"), *said, key, named.alias("named"), "entities", F.col(order).alias("listed")), "drafts")
    gated = links is not None
    ends = None
    if gated:
        both = links.select("left_id", "right_id").unionByName(links.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
        ends = materialize(both.distinct().join(df.select(F.col("draft_id").alias("left_id"), F.col("run_id").alias("of_run")), "left_id").select("of_run", "left_id", "right_id"), "draft-links")
    busy = mergeable(df, ends).join(df.select(F.col("draft_id").alias("left_id"), "run_id"), "left_id").select("run_id").distinct()
    busy = materialize(busy, "merging-runs")
    size = df.join(busy, "run_id").groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    if size > LARGEST_RUN:
        raise ValueError(f"a run has {size} drafts; one list holds {LARGEST_RUN} at most")
    kind = dict(df.dtypes)["run_id"]

    def run(rows: pa.Table, near: pa.Table) -> pa.Table:
        linked: dict[int, set[int]] = defaultdict(set)
        for a, b in zip(near["left_id"].to_pylist(), near["right_id"].to_pylist(), strict=True):
            linked[a].add(b)
        listed = sorted(rows.to_pylist(), key=lambda r: (r["listed"], r["draft_id"]))
        done = agglomerate([_Draft(r, linked[r["draft_id"]]) for r in listed], gated)
        out = {
            "run_id": [d.row["run_id"] for d in done], "draft_id": [min(d.of) for d in done], "place": list(range(len(done))), "members": [d.members for d in done], "relevance": [d.relevance for d in done],
            "category": [d.row["category"] for d in done], "headline": [d.row["headline"] for d in done], "entities": [[e for e, _ in d.named] if len(d.of) > 1 else d.row["entities"] for d in done], "lead_id": [d.row["draft_id"] for d in done], "parts": [d.of for d in done],
        }
        types = [rows.schema.field("run_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())]
        return pa.table({k: pa.array(x, t) for (k, x), t in zip(out.items(), types, strict=True)})

    near = ends if gated else df.select(F.col("run_id").alias("of_run"), F.col("draft_id").alias("left_id"), F.col("draft_id").alias("right_id")).where("false")
    looped = df.join(busy, "run_id", "left_semi").groupBy("run_id").cogroup(near.groupBy("of_run")).applyInArrow(run, _OUT.format(run=kind))
    place = F.expr("row_number() OVER (PARTITION BY run_id ORDER BY listed, draft_id) - 1").alias("place")
    quiet = df.join(busy, "run_id", "left_anti").select("run_id", "draft_id", place, *_SAID, "entities", F.col("draft_id").alias("lead_id"), F.array("draft_id").alias("parts"))
    now = materialize(looped.unionByName(quiet), "merged-drafts")
    return now.drop("parts"), now.select(F.explode("parts").alias("draft_id"), F.col("draft_id").alias("root"))
