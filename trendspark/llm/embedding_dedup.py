"""Near-duplicate embeddings by spherical-cap filters (Becker, Ducas, Gama and Laarhoven, SODA 2016).

Filter directions form a structured random product code: after a random rotation the space is cut into two halves, each
with its own random unit codewords, and every pair of codewords is a direction. A vector is list-decoded to all
directions within the cap: the halves' inner products are pruned against the threshold, so the full list of directions is
never walked for it. Vectors that share a filter (and label and dimension) are compared exactly. The number of directions
grows with the number of vectors, so a bucket grows only with the filters of a vector. The cap is set so that a vector meets as many
filters on average as two vectors at the least cosine need to share one with a chance of RECALL at that number of
directions, TARGET at least; one with fewer takes its best ones. Where no cap does (in few dimensions), all pairs are compared.

Copies collapse to one class first. A bucket over BLOCK vectors is dealt in blocks, all pairs of blocks. A pair found in
several filters counts in the smallest they share. Tasks return one row for each vector of a block: the sum of its links
there and one link to the smallest vector of its set, so rows never grow with the square of a group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import as_batch, bounded_batches, in_groups, link, runs, shuffle_partitions
from trendspark.operators.graph import connected_components
from trendspark.session import materialize

COSINE = 0.93
TARGET, FLOOR = 16, 10
#: The chance that a pair at the least cosine is found; it is tried on TRIALS random pairs, of which MISSES at most may be
#: missed: were the chance below RECALL, so few would be missed in 1 of 20 trials at most.
RECALL, TRIALS, MISSES = 0.999, 8000, 3
#: Vectors for each filter direction, and the least number of codewords of a half.
PER_FILTER, LEAST_WORDS = 12, 16
BLOCK = 512


def code(dim: int, words: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random rotation and the unit codewords of both halves."""
    rng = np.random.default_rng([seed, dim, words])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    halves = []
    for d in (dim // 2, dim - dim // 2):
        c = rng.standard_normal((words, max(1, d)))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return q * np.sign(np.diag(r)), halves[0], halves[1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square of a component is lost or too large."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def decode(x: np.ndarray, words: int, target: float = TARGET, floor: int = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters within the cap of each unit row of x, at least its `floor` best; rows ascend, then filters."""
    dim = x.shape[1]
    q, c1, c2 = code(dim, words)
    y = x @ q
    half = dim // 2
    s1 = y[:, :half] @ c1.T if half else np.zeros((len(x), words))
    s2 = y[:, half:] @ c2.T
    cap = NormalDist().inv_cdf(max(0.5, 1 - target / words**2)) * math.sqrt(2.0 / dim)  # of s1 + s2
    k = min(floor, words)
    top = (np.sort(s1, axis=1)[:, -k:, None] + np.sort(s2, axis=1)[:, None, -k:]).reshape(len(x), -1)
    least = np.minimum(cap, np.sort(top, axis=1)[:, -min(floor, top.shape[1])])
    row, w1 = np.nonzero(s1 + s2.max(axis=1, keepdims=True) >= least[:, None])
    hit, w2 = np.nonzero(s1[row, w1][:, None] + s2[row] >= least[row, None])
    return row[hit], w1[hit] * words + w2


def found(dim: int, words: int, target: float, least: float, trials: int = TRIALS, misses: int | None = None) -> tuple[int, int]:
    """(pairs that share a filter, pairs tried) of random unit vectors at cosine `least`; ends early beyond `misses` missed."""
    rng = np.random.default_rng([23, dim, words])
    hits, tried, step = 0, 0, max(1, min(500, (1 << 20) // words))
    while tried < trials and (misses is None or tried - hits <= misses):
        n = min(step, trials - tried)
        a, b = rng.standard_normal((2, n, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        keys = [row * words**2 + f for row, f in (decode(x, words, target, floor_of(target)) for x in (a, least * a + math.sqrt(1 - least**2) * b))]
        hits += len(np.unique(np.intersect1d(*keys, assume_unique=True) // words**2))
        tried += n
    return hits, tried


def floor_of(target: float) -> int:
    return math.ceil(target * FLOOR / TARGET)


@functools.cache
def filters_needed(dim: int, words: int, least: float) -> int | None:
    """Filters of a vector on average so that a pair at cosine `least` is found with a chance of RECALL; None if all pairs must meet."""
    if dim < 4 or least >= 1 or least <= -1:
        return None  # a half of one dimension has two directions only
    target = TARGET
    while target < words**2 / 2:
        hits, tried = found(dim, words, target, least, misses=MISSES)
        if tried - hits <= MISSES:
            return target
        target = math.ceil(target * 1.2)
    return None


def compare(va, wa, fa, vb, wb, fb, here: int, least: float, own: bool):  # noqa: ANN001, ANN201
    """Sums of the weights linked to each row of va and of vb at filter `here`, and the linked pairs (all of them).

    fa, fb: the filters of each row. A pair counts where `here` is the smallest filter both have. Links are found by the
    double-precision cosine of the unit rows. own: va is vb, each pair once.
    """
    near = va @ vb.T >= least
    if own:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    if not len(i):
        return None
    rows, cols = np.unique(i), np.unique(j)
    low_a, low_b = [fa[r][fa[r] < here] for r in rows], [fb[c][fb[c] < here] for c in cols]
    names = np.unique(np.concatenate([*low_a, *low_b]))
    ma, mb = np.zeros((len(rows), len(names)), dtype=np.float32), np.zeros((len(cols), len(names)), dtype=np.float32)
    for m, low in ((ma, low_a), (mb, low_b)):
        for k, f in enumerate(low):
            m[k, np.searchsorted(names, f)] = 1
    first = near[np.ix_(rows, cols)] & (ma @ mb.T == 0)
    la, lb = np.zeros(len(va), dtype=np.int64), np.zeros(len(vb), dtype=np.int64)
    la[rows] = first @ wb[cols]
    lb[cols] = wa[rows] @ first
    return la, lb, i, j


def _words(n: int) -> int:
    return max(LEAST_WORDS, 1 << math.ceil(math.log2(max(1, math.sqrt(n / PER_FILTER)))))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Vectors link if their labels and lengths are equal, the label is not null and the cosine is at least `least`.
    A vector that is null, empty or zero, or holds null, NaN or infinity, links with nothing: n_links 0, its own component.
    Repeated rows are copies and link to each other. Null ids are never a component_id unless the component has no other;
    kept holds where id and component_id are the same, null included. Other columns don't matter.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    element = vectors.schema[vector_col].dataType.elementType
    kept_as = "array<float>" if isinstance(element, T.FloatType) else "array<double>"  # shuffled as they are; compared in double
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kept_as).alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id")).withColumn("cls", F.monotonically_increasing_id())
    classes = materialize(classes, "vectors")
    total = classes.count()
    words = _words(total)
    targets = {r["dim"]: filters_needed(r["dim"], words, least) for r in classes.select(F.size("embedding").alias("dim")).distinct().collect()}

    def filters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                target = targets[dim]
                every, step = np.flatnonzero(sizes == dim), max(1, 2000 * TARGET // (target or TARGET))
                for k in range(0, len(every), step):
                    at = every[k : k + step]
                    x = flat[offsets[at][:, None] + np.arange(dim)]
                    x = unit(x)
                    row, held = decode(x, words, target, floor_of(target)) if target else (np.arange(len(x)), np.zeros(len(x), dtype=np.int64))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at)))]).astype(np.int32)
                    yield as_batch({"cls": b.column(0).take(pa.array(at)), "filters": pa.ListArray.from_arrays(pa.array(ends), pa.array(held.astype(np.int32)))})

    # The list decoding is done once; its lists are small beside the vectors, which the join below brings to them.
    lists = materialize(classes.select("cls", "embedding").mapInArrow(filters_of, "cls long, filters array<int>"), "vector-filters")
    vectors_in = classes.select("cls", "label", "n", F.size("embedding").alias("dim"), F.col("embedding").alias("vec"))
    dealt = lists.join(vectors_in, "cls").select("label", "dim", F.explode("filters").alias("filter"), "cls", "n", "vec", "filters")
    held = lists.join(vectors_in.drop("vec", "n"), "cls").select("label", "dim", F.explode("filters").alias("filter"))
    sizes = materialize(held.groupBy("label", "dim", "filter").count().where(f"count > {BLOCK}").select("label", "dim", "filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    large = sizes.agg(F.count("*")).first()[0]
    sized = dealt.join(F.broadcast(sizes) if large <= 100_000 else sizes, ["label", "dim", "filter"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sided = sized.withColumn("own", own).withColumn("other", other)
    sided = sided.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).withColumn("right", (F.col("own") > F.col("other")).cast("int"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["label", "dim", "filter", "p", "q"]):
            if t.num_rows < 2:
                continue
            dim, here = int(t["dim"][0].as_py()), int(t["filter"][0].as_py())
            cls, n, right = t["cls"].to_numpy(), t["n"].to_numpy(), t["right"].to_numpy()
            x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = unit(x.astype(np.float64))
            fs = np.empty(len(cls), dtype=object)
            held = t["filters"].combine_chunks()
            ends = np.cumsum(held.value_lengths().to_numpy())
            fs[:] = np.split(held.flatten().to_numpy(), ends[:-1]) if len(cls) > 1 else [held.flatten().to_numpy()]
            same = t["p"][0].as_py() == t["q"][0].as_py()
            a, b = (np.arange(len(cls)),) * 2 if same else (np.flatnonzero(right == 0), np.flatnonzero(right == 1))
            if not len(a) or not len(b) or (got := compare(x[a], n[a], fs[a], x[b], n[b], fs[b], here, least, same)) is None:
                continue
            la, lb, i, j = got
            links, labels = np.zeros(len(cls), dtype=np.int64), np.arange(len(cls))
            links[a] += la
            if not same:
                links[b] += lb
            link(labels, a[i], b[j])
            told = np.flatnonzero((links > 0) | (labels != np.arange(len(cls))))
            yield as_batch({"cls": cls[told], "links": links[told], "nbr": cls[labels[told]]})

    keys = ["label", "dim", "filter", "p", "q"]
    found = materialize(in_groups(sided.select(*keys, "right", "cls", "n", "vec", "filters"), keys, shuffle_partitions(spark), join, "cls long, links long, nbr long"), "vector-links")
    roots = connected_components(found, "cls", "nbr")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cls"))
    named = materialize(named.select("label", "embedding", "n", "first_id", "root", F.coalesce("links", F.lit(0)).alias("links")), "vector-roots")
    least_id = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "vector-least")
    named = named.join(least_id, "root").select("label", "embedding", F.lit(True).alias("usable"), (F.col("links") + F.col("n") - 1).alias("links"), "component_id", F.lit(1).alias("found"))
    out = rows.join(named, ["label", "embedding", "usable"], "left")
    component = F.when(F.col("found").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
