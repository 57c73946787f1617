"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.session import drop, materialize, short_shuffles


#: Up to so many edges one task links; rounds of joins cost more than that.
SMALL = 100_000


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place is joined with, from those known before (root) and edges of places."""
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of the one partition, by pointers to smaller nodes that are halved until they rest."""
    some = [b for b in batches if b.num_rows]
    if not some:
        return
    t = pa.Table.from_batches(some)
    nodes, ends = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
    a, b = ends[: t.num_rows], ends[t.num_rows :]
    root = forest(np.arange(len(nodes)), a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["node", "component"])


def _mins(edges: DataFrame) -> DataFrame:
    # Written out, so that the join below shuffles both sides by itself and AQE may split a hub's rows.
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = _mins(both)
    return both.where("v > u").join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), mins


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _mins(down)
    moved = down.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(mins.select("u", F.col("m").alias("v"))), mins


def _starred(edges: DataFrame, star: Callable[[DataFrame], tuple[DataFrame, DataFrame]], what: str) -> DataFrame:
    """The edges after a star operation, written; the tables that it read are removed."""
    found, mins = star(edges)
    found = materialize(found.distinct(), what)
    drop(mins)
    drop(edges)
    return found


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")), F.sum((F.xxhash64("v", "u") % 998_244_353).cast("long"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node reached.

    Self loops and rows with a null end join nothing and yield no row. Repeated edges count once.
    Up to SMALL edges are linked in one task; more stay distributed: each round costs two joins on the node, and rounds grow with the log of the diameter.
    """
    now = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v").distinct()
    with short_shuffles(edges.sparkSession):
        return _settled(materialize(now, "cc-edges"), max_rounds)


def _settled(now: DataFrame, max_rounds: int) -> DataFrame:
    before = _state(now)
    if 0 < before[0] <= SMALL:
        found = materialize(now.coalesce(1).mapInArrow(_linked, "node long, component long"), "cc-small-graph")
        drop(now)
        return found
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = _starred(_starred(now, _large_star, "cc-large"), _small_star, "cc-small")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
