"""Merkle manifest of a dataset: a tree of fanout FANOUT over the rows of each group, and one over the groups' roots.

Leaves are sorted and dealt to partitions by range; a partition knows the index of its first leaf in each group. It keeps
a mountain range: one open run of nodes for each level. Like a carry in base FANOUT, the node that ends a full run makes
the run's parent, which goes to the level above. Runs whose start lies in an earlier partition, or that are open at the
end, are the unaligned edges: at most 2 * (FANOUT - 1) nodes a level. Edges merge level by level in a shuffle by parent,
where the last run of a level may be short: it is hashed as it is, without padding. Nodes above and beside a partition
come back to it, so each leaf's proof is folded where its run is.

Only digests are shuffled; texts are read once. No task holds more than ROWS leaves, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import crc_bucket
from trendspark.session import materialize

#: A power of two.
FANOUT = 8
#: Leaves of a partition.
ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = pa.struct([("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])
_PROOFS = {"row": pa.int64(), "slot": pa.string(), "leaf": pa.string(), "index": pa.int64(), "levels": pa.int32(), "proof": pa.string(), "root": pa.string(), "subroot": pa.string(), "folded": pa.string(), "path": pa.list_(_NODE)}
_PROOFS_SQL = "row long, slot string, leaf string, index long, levels int, proof string, root string, subroot string, folded string, path array<struct<level: int, index: long, digest: string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value as `-` if null, else its UTF-8 bytes counted, a colon and the value."""
    fields = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


class Node(NamedTuple):
    level: int
    index: int
    digest: str


class Range:
    """The mountain range of consecutive leaves from index `start`: its completed nodes by level, and its edges."""

    def __init__(self, start: int) -> None:
        self.next = start
        self.open: list[list[Node]] = [[]]
        self.edges: list[Node] = []
        self.nodes: list[Node] = []

    def push(self, leaf: str) -> None:
        node = Node(0, self.next, leaf)
        self.next += 1
        while True:
            if node.level == len(self.open):
                self.open.append([])
            run = self.open[node.level]
            run.append(node)
            self.nodes.append(node)
            if node.index % FANOUT < FANOUT - 1:
                return
            self.open[node.level] = []
            if len(run) < FANOUT:  # its start lies in an earlier partition
                self.edges += run
                return
            node = Node(node.level + 1, node.index // FANOUT, digest(*(x.digest for x in run)))

    def close(self) -> list[Node]:
        """All edges: nodes whose parents other partitions take part in, or that end a short run."""
        for run in self.open:
            self.edges += run
        self.open = [[] for _ in self.open]
        return self.edges


def depth(n: int) -> int:
    """Levels above the leaves of n leaves; none above a lone leaf."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def fold(own: str, index: int, levels: int, nodes: dict[tuple[int, int], str], siblings: list[Node]) -> str:
    """The root over a leaf with digest `own` at `index`; adds the other nodes of each run on the way to siblings."""
    for level in range(levels):
        first = index // FANOUT * FANOUT
        run = [Node(level, k, own if k == index else nodes.get((level, k))) for k in range(first, first + FANOUT)]
        run = [x for x in run if x.digest is not None]  # a last run is short
        siblings += (x for x in run if x.index != index)
        own, index = digest(*(x.digest for x in run)), index // FANOUT
    return own


@dataclass
class Tree:
    """Leaves as dealt to partitions, the first index of each partition and slot, and the nodes that no partition completed alone."""

    dealt: DataFrame
    starts: DataFrame
    seams: DataFrame
    levels: int


def _by_slot(rows: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """The leaves of each slot in a partition, in order."""
    rows = rows.sort_by([("slot", "ascending"), ("at", "ascending")])
    slots = rows["slot"].to_pylist()
    first = 0
    for k in range(1, len(slots) + 1):
        if k == len(slots) or slots[k] != slots[first]:
            yield slots[first], rows.slice(first, k - first)
            first = k


def _mountains(start: int, leaves: pa.ChunkedArray) -> Range:
    out = Range(start)
    for x in leaves.to_pylist():
        out.push(x)
    return out


def _edges(rows: pa.Table, starts: pa.Table) -> pa.Table:
    """The edges of a partition's ranges."""
    facts = {x["slot"]: x for x in starts.to_pylist()}
    out = [(slot, depth(facts[slot]["total"]), *node) for slot, own in _by_slot(rows) for node in _mountains(facts[slot]["start"], own["leaf"]).close()]
    columns = list(zip(*out, strict=True)) or [[]] * 5
    types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
    return pa.table({k: pa.array(x, t) for k, x, t in zip(("slot", "depth", "level", "index", "digest"), columns, types, strict=True)})


def _proofs(paths: bool):  # noqa: ANN202
    """Of each leaf its proof, and the root that its other leaf folds to; the siblings too if `paths`."""

    def work(rows: pa.Table, facts: pa.Table) -> pa.Table:
        known = {x["slot"]: x for x in facts.to_pylist()}
        out: dict[str, list] = {k: [] for k in _PROOFS}
        for slot, own in _by_slot(rows):
            fact = known[slot]
            first, levels = fact["start"], depth(fact["total"])
            near = {(x["level"], x["index"]): x["digest"] for x in fact["nodes"] or ()}
            above = {(x["level"], x["index"]): x["digest"] for x in fact["path"] or ()}
            nodes = near | {(x.level, x.index): x.digest for x in _mountains(first, own["leaf"]).nodes}
            up = fact["up_index"] or 0, fact["up_levels"] or 0, above
            for k, (row, x, other) in enumerate(zip(own["row"].to_pylist(), own["leaf"].to_pylist(), own["other"].to_pylist(), strict=True), first):
                path: list[Node] = []
                subroot = fold(x, k, levels, nodes, path)
                own_path = [{"level": y.level, "index": y.index, "digest": y.digest} for y in path] if paths else None
                root = fold(subroot, *up, path)
                folded = root if other == x else fold(fold(other, k, levels, nodes, []), *up, [])
                found = (row, slot, x, k, levels, digest(*(y.digest for y in path)), root, subroot, folded, own_path)
                for name, value in zip(out, found, strict=True):
                    out[name].append(value)
        return pa.table({k: pa.array(out[k], t) for k, t in _PROOFS.items()})

    return work


def mountains(leaves: DataFrame) -> Tree:
    """The trees of leaves with a slot (a string for each tree), a row, sort keys k1 and k2, leaf and other.

    Leaves of a slot ascend by k1 (null first), k2, leaf and row. A seam is (slot, depth, level, index, digest); the root
    of a slot is the one with level = depth.
    """
    order = [F.col("slot"), F.col("k1").asc_nulls_first(), F.col("k2").asc_nulls_first(), F.col("leaf"), F.col("row")]
    parts = max(1, -(-leaves.count() // ROWS))
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "slot", "row", "leaf", "other"), "leaves")
    counts = dealt.groupBy("slot", "part").agg(F.count("*").alias("n"))
    before = "sum(n) OVER (PARTITION BY slot ORDER BY part) - n AS start"
    starts = materialize(counts.selectExpr("part", "slot", "n", before, "sum(n) OVER (PARTITION BY slot) AS total"), "leaf-starts")
    edges = dealt.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(_edges, "slot string, depth int, level int, index long, digest string")
    edges = materialize(edges, "edges")
    levels = depth(starts.agg(F.max("total")).first()[0] or 0)
    seams = now = edges.where("level = 0")
    for level in range(levels):
        run = F.sort_array(F.collect_list(F.struct("index", "digest")))  # at most FANOUT nodes
        joined = F.array_join(F.transform(run, lambda x: x["digest"]), "")
        merged = now.where("level < depth").groupBy("slot", "depth", F.expr(f"index div {FANOUT}").alias("index")).agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
        merged = merged.select("slot", "depth", F.lit(level + 1).alias("level"), "index", "digest")
        now = materialize(edges.where(F.col("level") == level + 1).unionByName(merged), "seams")
        seams = seams.unionByName(now)
    return Tree(dealt, starts, seams, levels)


def proofs(tree: Tree, above: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """A row for each leaf: row, slot, leaf, index, levels, proof, root, subroot, folded and path.

    above: (slot, up_index, up_levels, path), the way of each slot's root in a tree over them; without it, subroot and
    root are the same. A partition asks only for the runs over its first and its last leaf, at every level.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(0, tree.levels - 1)))).alias("level")
    ends = F.array_distinct(F.array(F.col("start"), F.expr("start + n - 1"))).alias("ends")
    asked = tree.starts.select("part", "slot", levels, ends).select("part", "slot", "level", F.explode("ends").alias("end"))
    width = f"shiftleft(1L, {FANOUT.bit_length() - 1} * (level + 1))"
    asked = asked.selectExpr("part", "slot", "level", f"end div {width} AS run").distinct()
    told = tree.seams.withColumn("run", F.expr(f"index div {FANOUT}")).join(asked, ["slot", "level", "run"])
    told = told.groupBy("part", "slot").agg(F.collect_list(F.struct("level", "index", "digest")).alias("nodes"))
    facts = tree.starts.select("part", "slot", "start", "total").join(told, ["part", "slot"], "left")
    if above is None:
        facts = facts.selectExpr("*", "0L AS up_index", "0 AS up_levels", "CAST(NULL AS array<struct<level: int, index: long, digest: string>>) AS path")
    else:
        facts = facts.join(above, "slot", "left")
    return tree.dealt.groupBy("part").cogroup(facts.groupBy("part")).applyInArrow(_proofs(paths), _PROOFS_SQL)


@dataclass
class Manifest:
    """leaves: key, leaf, index in its group, subroot, root, proof, folded_root and verified of each row. groups: group,
    subroot and root. seams: the nodes (slot, depth, level, index, digest) where the partitions' ranges were joined."""

    leaves: DataFrame
    groups: DataFrame
    seams: DataFrame


def manifest(rows: DataFrame, values: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", text: str = "text", tampered: Column | None = None) -> Manifest:
    """The manifest of rows, whose leaves are the digests of their `values`.

    Leaves of a group ascend by `key`, rows of equal keys by leaf; a null key comes first. Groups ascend by their UTF-8
    bytes, the null group first; null and empty are two groups. Where `tampered` holds (not where it is null), the folded
    root starts from the row with A-Z of `text` in lower case. Repeated rows are leaves of their own. A proof is the
    digest of the siblings' digests, from the leaf's run up to the root; of none, if there is one leaf only. An empty
    table has no rows, no groups and no root. Other columns don't matter, whatever their names.
    """
    own = [F.col(v) for v in values]
    other = [F.translate(F.col(v), UPPER, LOWER) if v == text else F.col(v) for v in values]
    slot = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = rows.select(F.monotonically_increasing_id().alias("row"), slot.alias("slot"), F.col(key).alias("k1"), F.lit(0).alias("k2"), leaf(own).alias("leaf"), F.when(changed, leaf(other)).alias("other"))
    leaves = materialize(leaves.withColumn("other", F.coalesce("other", "leaf")), "row-leaves")
    tree = mountains(leaves)
    roots = tree.seams.where("level = depth")
    named = F.when(F.col("slot") != "-", F.substring("slot", 2, 1 << 30))
    tops = roots.select(F.lit("").alias("slot"), F.monotonically_increasing_id().alias("row"), named.isNotNull().alias("k1"), named.cast("binary").alias("k2"), F.col("digest").alias("leaf"), F.col("digest").alias("other"), F.col("slot").alias("group"))
    tops = materialize(tops, "subroots")
    upper = proofs(mountains(tops.drop("group")), paths=True).select("row", "leaf", "index", "levels", "root", "path")
    upper = materialize(tops.select("row", F.col("group").alias("slot")).join(upper, "row"), "upper-proofs")
    found = proofs(tree, upper.select("slot", F.col("index").alias("up_index"), F.col("levels").alias("up_levels"), "path"))
    keys = leaves.select("row", F.col("k1").alias(key))
    out = found.join(keys, "row").select(key, "leaf", "index", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
    groups = upper.select(named.alias(group), F.col("leaf").alias("subroot"), "root")
    return Manifest(out, groups, tree.seams)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = manifest(docs, tampered=crc_bucket(F.col("doc_id"), 3) == 0).leaves
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
