"""Hard-negative mining by norm-bucketed search for largest inner products.

Vectors become integers, so scores are exact. Candidates are sorted by falling length, dealt to shards of SHARD rows and,
inside a shard, to buckets of BUCKET rows. A query is an anchor with a window of scores; it keeps the first K rows of its
window. By Cauchy and Schwarz no score of a bucket is above the anchor's length times that of the bucket's longest row:
a bucket is skipped where that bound is below the window's lower limit, or below the running kth score. As buckets get
shorter, all that follow are skipped too.

The shard of the longest rows is searched first; the kth scores found there decide which of the other shards a query is
sent to at all. Queries of a shard are dealt in blocks of ANCHORS, so that a task holds one shard and one block. Each
yields K rows a query at most, of which a window with a limit, pre-aggregated before the shuffle, keeps the first K.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import bounded_batches
from trendspark.session import materialize

K = 5
SHARD, BUCKET, ANCHORS = 4096, 512, 2048
SCALE = 256
#: Squared lengths below this keep scores within 64 bits; below the other all sums are exact as doubles.
MOST, EXACT = 1 << 62, 1 << 52
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null if the vector is, or holds null, NaN, infinity or what exceeds 32 bits."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    fits = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * SCALE < float(1 << 31)))
    return F.when(fits, x)


def squared(vector: Column) -> Column:
    """The squared length, as a decimal, which can't overflow."""
    return F.aggregate(vector, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(18,0)") * x.cast("decimal(18,0)")).cast("decimal(38,0)"))


def matrix(vectors: pa.ChunkedArray | pa.Array, exact: bool) -> np.ndarray:
    """Vectors of one length as rows: doubles, or 64-bit integers where doubles would round."""
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), len(flat) // len(vectors)).astype(np.float64 if exact else np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k that fit, by falling score, then rising id."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def tile(queries: pa.Table, shard: pa.Table, k: int) -> Iterator[tuple]:
    """(query, row, id, score) of the first k rows of each query's window in a shard whose rows get shorter."""
    shard = shard.sort_by([("squared", "descending"), ("row", "ascending")])
    lengths = shard["squared"].to_numpy().astype(np.float64)
    q_lengths = queries["squared"].to_numpy().astype(np.float64)
    exact = max(lengths.max(), q_lengths.max()) < EXACT
    vectors, anchors = matrix(shard["vector"], exact), matrix(queries["vector"], exact)
    kinds, codes = np.unique(np.concatenate([np.asarray(x["label"].to_pylist(), dtype=object).astype(str) for x in (shard, queries)]), return_inverse=True)
    labels, q_labels = codes[: len(vectors)], codes[len(vectors) :]
    rows, ids = shard["row"].to_numpy(), shard["id"].fill_null(_HIGH).to_numpy()
    own, low, high, floor, same = (queries[c].to_numpy() for c in ("own", "low", "high", "floor", "same"))
    # One product for each anchor of a bucket, whatever its queries.
    names, first, anchor = np.unique(queries["own"].to_numpy(), return_index=True, return_inverse=True)
    kept: list[list[np.ndarray]] = [[] for _ in own]
    running = np.maximum(low, floor).astype(np.int64)
    open_ = np.ones(len(own), dtype=bool)
    for a in range(0, len(vectors), BUCKET):
        # Rounded up: a bound may be too high, never too low.
        bound = np.sqrt(q_lengths * lengths[a]) * (1 + 1e-9) + 1
        open_ &= bound >= running
        if not open_.any():
            break
        used = np.unique(anchor[open_])
        scores = anchors[first[used]] @ vectors[a : a + BUCKET].T
        place = np.searchsorted(used, anchor)
        for q in np.flatnonzero(open_).tolist():
            s = scores[place[q]]
            fits = (s >= running[q]) & (s <= high[q]) & ((labels[a : a + BUCKET] == q_labels[q]) == same[q]) & (rows[a : a + BUCKET] != own[q])
            if not fits.any():
                continue
            got = np.flatnonzero(fits) if fits.sum() <= k else first_of(s, ids[a : a + BUCKET], fits, k)
            some = np.stack([s[got].astype(np.int64), ids[a : a + BUCKET][got], got + a])
            every = np.concatenate([*kept[q], some], axis=1)
            every = every[:, np.lexsort((every[2], every[1], -every[0]))[:k]]
            kept[q] = [every]
            if every.shape[1] == k:
                running[q] = max(running[q], every[0, -1])
    qids = queries["query"].to_numpy()
    raw_ids = shard["id"]
    for q, found in enumerate(kept):
        if found:
            for score, _, at in found[0].T.tolist():
                yield int(qids[q]), int(rows[at]), raw_ids[at].as_py(), score


_FOUND = "query long, row long, id long, score long"
_SHARD = ["row", "id", "label", "squared", "vector"]
_QUERY = ["query", "own", "label", "squared", "vector", "low", "high", "floor", "same"]


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query, row, id, score, rank): the first k candidates of each query's window, by falling score, then rising id.

    candidates: shard, row, id, label, dim, squared and vector, shard 0 with the longest. queries: query, own (its own
    row, which is left out), label, dim, squared, vector, low and high (both in the window) and same: whether the
    label must be the query's or must differ from it. Only vectors of equal dimensions are compared. A null id comes last.
    """
    k_ = k

    def work(q: pa.Table, shard: pa.Table) -> pa.Table:
        found = list(tile(q, shard, k_)) if q.num_rows and shard.num_rows else []
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query", "row", "id", "score"), columns, strict=True)})

    shards = candidates.groupBy("dim", "shard").agg(F.max("squared").alias("longest"), F.count("*").alias("rows"))
    shards = materialize(shards, "shards")
    block = F.pmod(F.xxhash64("own"), F.lit(max(1, -(-queries.select("own").distinct().count() // ANCHORS)))).alias("block")

    def tiles(asked: DataFrame) -> DataFrame:
        """asked: queries, each with the shards it is sent to."""
        asked = asked.select("dim", "shard", block, *_QUERY)
        blocks = asked.select("dim", "shard", "block").distinct()
        sides = candidates.join(blocks, ["dim", "shard"]).select("dim", "shard", "block", *_SHARD)
        key = ["dim", "shard", "block"]
        right = sides.select(*(F.col(c).alias(f"c_{c}") for c in sides.columns))  # both sides may come from one table
        named = [f"c_{c}" for c in _SHARD]
        cells = asked.groupBy(*key).cogroup(right.groupBy(*(f"c_{c}" for c in key)))
        return cells.applyInArrow(lambda a, b: work(a.select(_QUERY), b.select(named).rename_columns(_SHARD)), _FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = "row_number() OVER (PARTITION BY query ORDER BY score DESC, id ASC NULLS LAST, row) AS rank"
        return found.selectExpr("*", order).where(F.col("rank") <= k)

    top = materialize(best(tiles(queries.withColumn("floor", F.lit(_LOW).cast("long")).withColumn("shard", F.lit(0)))), "longest")
    kth = top.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    rest = queries.join(kth, "query", "left").withColumn("floor", F.coalesce("kth", F.lit(_LOW).cast("long")))
    rest = rest.join(F.broadcast(shards.where("shard > 0")) if shards.count() <= 100_000 else shards.where("shard > 0"), "dim")
    bound = F.sqrt(F.col("squared").cast("double") * F.col("longest").cast("double")) * (1 + 1e-9) + 1
    rest = rest.where(bound >= F.greatest("low", "floor")).select("dim", "shard", *_QUERY)
    return best(top.drop("rank").unionByName(tiles(rest)))


def mine(vectors: DataFrame, anchors: Column, low: tuple[int, int] = (80, 100), k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), the hard negatives of the anchors.

    anchors: which rows of vectors are anchors. An anchor's positives are the first k other rows of its label and
    dimension, by falling inner product of the quantised vectors, then rising id; the negatives of a positive the first k
    rows of other labels whose score s satisfies low[0] * positive_score <= low[1] * s <= low[1] * positive_score.
    Rows with a null label or vector, or a component that is null, not finite or of 2**23 and more, take no part, nor do
    vectors of a squared length of 2**62 or more, whose scores might not fit. A zero vector and an empty one score 0. A
    repeated row is another row; a null id comes last, and is an anchor if `anchors` holds. Other columns don't matter.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), quantised(F.col(vector_col)).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("label IS NOT NULL AND vector IS NOT NULL").withColumn("squared", squared(F.col("vector"))).where(F.col("squared") < MOST)
    rows = materialize(rows.withColumn("squared", F.col("squared").cast("long")).withColumn("dim", F.size("vector")), "quantised")
    parts = max(1, -(-rows.count() // SHARD))
    order = [F.col("dim"), F.col("squared").desc(), F.col("row")]
    dealt = rows.repartitionByRange(parts, *order).withColumn("shard", F.spark_partition_id())
    dealt = materialize(dealt, "dealt")
    least = dealt.groupBy("dim").agg(F.min("shard").alias("first"))
    candidates = materialize(dealt.join(least, "dim").withColumn("shard", F.col("shard") - F.col("first")).drop("first"), "candidates")
    own = candidates.where("anchor").select(F.col("row").alias("own"), F.col("id").alias("anchor_id"), "label", "dim", "squared", "vector")
    wide = [F.lit(x).cast("long").alias(n) for x, n in ((_LOW, "low"), (_HIGH, "high"))]
    asked = own.select(F.col("own").alias("query"), "own", "label", "dim", "squared", "vector", *wide, F.lit(True).alias("same"))
    positives = materialize(search(asked, candidates, k).select("query", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    numbered = materialize(positives.where("positive_score >= 0").withColumnRenamed("query", "own").withColumn("query", F.monotonically_increasing_id()), "windows")
    limit = F.expr(f"(CAST(positive_score AS DECIMAL(38, 0)) * {low[0]} + {low[1] - 1}) div {low[1]}")
    asked = numbered.withColumn("low", limit).withColumn("high", F.col("positive_score")).join(own.drop("anchor_id"), "own").withColumn("same", F.lit(False))
    negatives = search(asked.select("query", "own", "label", "dim", "squared", "vector", "low", "high", "same"), candidates, k)
    told = numbered.join(own.select("own", "anchor_id"), "own")
    return negatives.join(told, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
