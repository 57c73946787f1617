"""Groups of vectors in the candidates of a run, without a matrix of all of them.

Vectors of a block are dealt into parts of TILE; a task takes two parts. For single linkage it yields their spanning tree:
the tree of a block is made of edges that lie in the tree of some pair of parts, so the trees of all pairs hold it, and
trees of trees are taken until one task can finish. For complete linkage in order it yields the pairs that are alike
enough; whether a vector may join a group follows from how many of its members it is paired with. Groups are then held
against their centroids: in one task each, the largest ones by rounds of aggregates. Last tasks hold a few numbers for each
vector of a block, never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendspark.functions import normalize as N
from trendspark.session import materialize

TILE = 1024
#: Edges that one task takes of a block, and members of a group that one task holds against their centroid.
EDGES, MEMBERS = 2_000_000, 50_000
_KEY = ["block", "dim"]


def _valid(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & (F.size(v) > 0)


def units(vectors: DataFrame, block: str) -> DataFrame:
    """(block, dim, nth, vec_id, embedding): unit vectors numbered in the order of vec_id in their block and length.

    A vector that is null or empty, or holds what is no finite number, has no row.
    """
    e = F.col("embedding").cast("array<double>")
    rows = vectors.where(_valid(e)).select(F.col(block).cast("string").alias("block"), F.size("embedding").alias("dim"), F.col("vec_id").cast("long").alias("vec_id"), N.unit_vector(e).alias("embedding"))
    return materialize(rows.withColumn("nth", F.row_number().over(W.partitionBy(*_KEY).orderBy("vec_id"))), "units")


def cells(u: DataFrame, inner: bool) -> DataFrame:
    """Rows of units for each pair of parts (p, q) of their block that they take part in; with inner, each part alone too."""
    parts = u.groupBy(*_KEY).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    dealt = u.join(parts, _KEY).withColumn("own", F.pmod("nth", "parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    if not inner:
        dealt = dealt.where((F.col("own") != F.col("other")) | (F.col("parts") == 1))
    return dealt.select(*_KEY, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "nth", "embedding")


def _matrix(t: pa.Table) -> np.ndarray:
    return t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _edges(t: pa.Table, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> pa.Table:
    n = len(a)
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.table({"block": pa.array([t["block"][0].as_py()] * n, pa.string()), "dim": pa.array([t["dim"][0].as_py()] * n, pa.int32()), "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()), "weight": pa.array(weight, pa.float64())})


_EDGE = "block string, dim int, low int, high int, weight double"


def _tree(t: pa.Table) -> pa.Table:
    """The spanning tree of a cell by squared distance (Prim), equal ones by the numbers of the ends."""
    t = t.sort_by("nth")
    x, nth = _matrix(t), t["nth"].to_numpy()
    n = len(x)
    square = (x * x).sum(axis=1)
    near, source, out = np.full(n, np.inf), np.zeros(n, dtype=int), np.ones(n, dtype=bool)
    a, b, w, at = [], [], [], 0
    out[0] = False
    for _ in range(n - 1):
        d = np.round(np.maximum(square + square[at] - 2.0 * (x @ x[at]), 0.0), 12)
        closer = out & (d < near)
        near[closer], source[closer] = d[closer], at
        at = int(np.argmin(np.where(out, near, np.inf)))
        a.append(source[at])
        b.append(at)
        w.append(near[at])
        out[at] = False
    return _edges(t, nth[np.array(a, dtype=int)], nth[np.array(b, dtype=int)], np.array(w, dtype=float))


def _joined(t: pa.Table) -> tuple[pa.Table, list[int]]:
    """Edges by weight, then ends, and which of them join two parts that were apart (Kruskal)."""
    t = t.sort_by([("weight", "ascending"), ("low", "ascending"), ("high", "ascending")])
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = k = root[root[k]]
        return k

    kept = []
    for i, (a, b) in enumerate(zip(t["low"].to_pylist(), t["high"].to_pylist(), strict=True)):
        if (ra := find(a)) != (rb := find(b)):
            root[ra] = rb
            kept.append(i)
    return t, kept


def _forest(t: pa.Table) -> pa.Table:
    t, kept = _joined(t)
    return t.select(["block", "dim", "low", "high", "weight"]).take(pa.array(kept, pa.int64()))


def _leaves(t: pa.Table) -> pa.Table:
    """(block, dim, nth, leaf): members of the parts that split off a part of two or more and split no further."""
    t, kept = _joined(t)
    home: dict[int, int] = {}
    parts: dict[int, tuple[list[int], bool]] = {}
    leaves: list[list[int]] = []
    for i in kept:
        for k in (low := t["low"][i].as_py(), high := t["high"][i].as_py()):
            if k not in home:
                home[k], parts[k] = k, ([k], False)
        (a, split_a), (b, split_b) = parts.pop(home[low]), parts.pop(home[high])
        both = len(a) >= 2 and len(b) >= 2
        if both:
            leaves += [list(p) for p, split in ((a, split_a), (b, split_b)) if not split]
        (a, b), root = ((a, b), home[low]) if len(a) >= len(b) else ((b, a), home[high])
        parts[root] = (a + b if both else a, both or split_a or split_b)
        if not both:
            a += b
        for m in b:
            home[m] = root
    rows = [(k, n) for n, leaf in enumerate(leaves) for k in leaf]
    nth, leaf = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [])
    return pa.table({"block": pa.array([t["block"][0].as_py()] * len(nth), pa.string()), "dim": pa.array([t["dim"][0].as_py()] * len(nth), pa.int32()), "nth": pa.array(nth, pa.int32()), "leaf": pa.array(leaf, pa.int32())})


def density_leaves(u: DataFrame) -> DataFrame:
    """(block, dim, nth, leaf) of units: density clusters for which two points make one and every point is a core of its own."""
    cell = cells(u, False).groupBy(*_KEY, "p", "q")
    edges = materialize(cell.applyInArrow(_tree, _EDGE), "cell-trees")
    while True:
        most = edges.groupBy(*_KEY).count().agg(F.max("count")).first()[0] or 0
        if most <= EDGES:
            return edges.groupBy(*_KEY).applyInArrow(_leaves, "block string, dim int, nth int, leaf int")
        # Trees of shares of a block's edges hold its tree.
        share = F.pmod(F.xxhash64("low", "high"), F.lit(-(-most // EDGES)))
        fewer = materialize(edges.withColumn("share", share).groupBy(*_KEY, "share").applyInArrow(_forest, _EDGE), "fewer-trees")
        if (now := fewer.groupBy(*_KEY).count().agg(F.max("count")).first()[0]) >= most:
            raise ValueError(f"a block has a tree of {now} edges; a task takes {EDGES}")
        edges = fewer


def _alike(least: float):  # noqa: ANN202
    def work(t: pa.Table) -> pa.Table:
        x, nth, own = _matrix(t), t["nth"].to_numpy(), t["own"].to_numpy()
        left = own == own.min()
        if left.all():
            i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
            return _edges(t, nth[i], nth[j], (x[i] * x[j]).sum(axis=1))
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        i, j = np.nonzero(x[a] @ x[b].T >= least)
        i, j = a[i], b[j]
        return _edges(t, nth[i], nth[j], (x[i] * x[j]).sum(axis=1))

    return work


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, dim, nth, leaf) from pairs in the order of block and of the later vector, by ordered complete linkage.

    A vector joins the group all of whose members it is paired with and whose least similarity is greatest, the one begun
    first on ties; else it begins one. leaf is the number of the group's first member.
    """
    key, home, size = None, {}, {}
    late, seen = None, {}

    def settle() -> None:
        fits = [(-worst, g) for g, (n, worst) in seen.items() if n == size[g]]
        home[late] = min(fits)[1] if fits else late
        size[home[late]] = size.get(home[late], 0) + 1

    def told() -> pa.RecordBatch:
        rows = [(k, g) for k, g in home.items() if size[g] >= 2]
        columns = [pa.array([key[0]] * len(rows), pa.string()), pa.array([key[1]] * len(rows), pa.int32()), *(pa.array([r[c] for r in rows], pa.int32()) for c in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "dim", "nth", "leaf"])

    for batch in batches:
        for block, dim, low, high, sim in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "low", "high", "weight")), strict=True):
            if (block, dim) != key or high != late:
                if late is not None:
                    settle()
                if (block, dim) != key:
                    if key is not None:
                        yield told()
                    key, home, size = (block, dim), {}, {}
                late, seen = high, {}
            if low not in home:  # no earlier vector was alike
                home[low], size[low] = low, 1
            g = home[low]
            n, worst = seen.get(g, (0, np.inf))
            seen[g] = (n + 1, min(worst, sim))
    if late is not None:
        settle()
        yield told()


def threshold_groups(u: DataFrame, linkage: float) -> DataFrame:
    """(block, dim, nth, leaf) of units by complete linkage in their order; vectors alone in their group have no row."""
    pairs = materialize(cells(u, True).groupBy(*_KEY, "p", "q").applyInArrow(_alike(linkage), _EDGE), "alike-pairs")
    return pairs.repartition(*_KEY).sortWithinPartitions(*_KEY, "high", "low").mapInArrow(_assign, "block string, dim int, nth int, leaf int")


def _gate(least: float):  # noqa: ANN202
    def work(t: pa.Table) -> pa.Table:
        """Members by similarity to the centroid after the least similar are dropped one by one, the earlier one on ties."""
        t = t.sort_by("nth")
        x, keep = _matrix(t), np.ones(t.num_rows, dtype=bool)
        order: list[int] = []
        while keep.sum() >= 2:
            c = x[keep].mean(axis=0)
            sims = np.where(keep, np.round(x @ (c / (np.sqrt(c @ c) or 1.0)), 9), np.inf)
            worst = int(np.argmin(sims))
            if sims[worst] >= least:
                order = sorted(np.flatnonzero(keep).tolist(), key=lambda i: -sims[i])
                break
            keep[worst] = False
        out = t.select(["block", "dim", "leaf", "nth", "vec_id"]).take(pa.array(order, pa.int64()))
        first = min(out["vec_id"].to_pylist(), default=None)
        return out.append_column("group_id", pa.array([first] * len(order), pa.int64())).append_column("place", pa.array(range(1, len(order) + 1), pa.int32()))

    return work


def _gate_rounds(held: DataFrame, least: float) -> DataFrame:
    """As _gate, for groups too large for a task: each round drops the least similar member of every group by aggregates."""
    key = [*_KEY, "leaf"]
    now, done = held, None
    while True:
        parts = now.select(*key, F.posexplode("embedding").alias("i", "x")).groupBy(*key, "i").agg(F.avg("x").alias("m"))
        centre = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        length = F.sqrt(dot(F.col("c"), F.col("c")))
        sim = F.round(dot(F.col("embedding"), F.col("c")) / F.when(length == 0, 1.0).otherwise(length), 9)
        sims = materialize(now.join(centre, key).withColumn("sim", sim).drop("c"), "gate-sims")
        worst = materialize(sims.groupBy(*key).agg(F.min(F.struct("sim", "nth")).alias("worst"), F.count("*").alias("n")), "gate-worst")
        settled = worst.where(F.col("worst.sim") >= least).where("n >= 2").select(*key)
        kept = sims.join(settled, key, "left_semi")
        done = kept if done is None else done.unionByName(kept)
        open_ = worst.where((F.col("worst.sim") < least) & (F.col("n") > 2))
        now = materialize(sims.join(open_.select(*key, F.col("worst.nth").alias("gone")), key).where("nth <> gone").drop("gone", "sim"), "gate-left")
        if now.isEmpty():
            break
    ranked = done.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("sim"), "nth")))
    first = done.groupBy(*key).agg(F.min("vec_id").alias("group_id"))
    return ranked.join(first, key).select(*key, "nth", "vec_id", "group_id", F.col("place").cast("int").alias("place"))


def gated(members: DataFrame, least: float) -> DataFrame:
    """(block, dim, leaf, nth, vec_id, group_id, place) of groups (block, dim, leaf, nth, vec_id, embedding) that hold together.

    The least similar member to the centroid goes until all reach `least` (similarities to nine places, so that equal ones
    are ties, which the earlier member loses and leads); fewer than two left dissolve a group. group_id
    is the smallest vec_id kept, place 1 the most central member.
    """
    key = [*_KEY, "leaf"]
    held = materialize(members.select(*key, "nth", "vec_id", "embedding"), "gate-members")
    large = materialize(held.groupBy(*key).count().where(F.col("count") > MEMBERS).select(*key), "large-groups")
    kind = "block string, dim int, leaf int, nth int, vec_id long, group_id long, place int"
    out = held.join(large, key, "left_anti").groupBy(*key).applyInArrow(_gate(least), kind)
    if large.isEmpty():
        return out
    return out.unionByName(_gate_rounds(held.join(large, key, "left_semi"), least))


def vector_groups(vectors: DataFrame, block: str, method: str = "density", least: float = 0.55, linkage: float = 0.78) -> DataFrame:
    """(block, vec_id, group_id, place) of vectors (block, vec_id, embedding); group_id and place are null for noise.

    method: `density` (leaves of single linkage), `threshold` (complete linkage in order of vec_id at `linkage`) or `given` (a
    block is one group). Every group is then held against its centroid (gated). Vectors of other lengths never meet; those
    that are null, empty or not finite are noise. A repeated vec_id is another vector. The block is told as a string.
    """
    u = units(vectors, block)
    if method == "given":
        members = u.withColumn("leaf", F.lit(0))
    else:
        found = density_leaves(u) if method == "density" else threshold_groups(u, linkage)
        members = u.join(found, [*_KEY, "nth"])
    kept = gated(members, least).select(*_KEY, "nth", "group_id", "place")
    told = u.join(kept, [*_KEY, "nth"], "left").select("block", "vec_id", "group_id", "place")
    odd = vectors.where(~F.coalesce(_valid(F.col("embedding").cast("array<double>")), F.lit(False)))
    return told.unionByName(odd.select(F.col(block).cast("string").alias("block"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(None).cast("long").alias("group_id"), F.lit(None).cast("int").alias("place")))
