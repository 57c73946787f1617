"""SimHash near-duplicates: self-joins of binary tries of fingerprints under a Hamming budget.

A trie of fingerprints is walked against itself, a pair of nodes at a time. A pair carries the bits in which its two
prefixes differ; a pair over the budget is dropped with all below it. One trie over all fingerprints would pair each subtree
with every other one within the budget, which repeats a fingerprint the more often the deeper the subtrees lie. So BUDGET + 1
tries are kept, the i-th over the fingerprints turned so that they begin with their i-th block of bits: two fingerprints
within the budget agree in a whole block, so some trie has both below one node at the depth of a block, and its walk starts
from such nodes, each with itself. A fingerprint is dealt once for each trie, at any size of the table.

A node with more than SUBTREE fingerprints below it is cut by the same argument over the bits that are left, and again, until
few enough bits are left (LEFT_BITS) that no node can hold more than 2 ** LEFT_BITS distinct fingerprints.

Copies collapse to one fingerprint before the join. A task returns at most one link per fingerprint it read (stars of
the sets it found), so links never grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import as_batch, bounded_batches, in_groups, link, shuffle_partitions, text_bytes
from trendspark.operators.graph import connected_components
from trendspark.session import materialize

BUDGET = 2
SHINGLE = 3
SEED = 42
#: Fingerprints below a node that is not cut further, and bits under which no node needs to be.
SUBTREE, LEFT_BITS = 65_536, 18
#: Fingerprints that a task walks at once (whole nodes), and nodes to cut that are broadcast at most.
WALKED, BROADCAST_NODES = 1 << 20, 100_000
#: A pair of nodes with so few pairs of fingerprints is compared at once.
FEW = 64
#: Pairs of fingerprints compared in one step.
STEP = 1 << 21


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles, repeats included; 0 if there is no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:], strict=False)]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64, count=len(shingles))
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp is the fingerprint as a signed long. A null text has no words."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in text_bytes(b.column(1))], dtype=np.uint64)
            yield as_batch({"doc_id": b.column(0), "fp": fp.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def turned(fp: np.ndarray, trie: int, budget: int) -> tuple[np.ndarray, int]:
    """The fingerprints with the blocks that lead in their trie first, and the bits of these blocks.

    trie: a number whose digits to the base budget + 2, from the last, are 1 + the block that leads at each cut.
    """
    x, done, base = fp.astype(np.uint64), 0, budget + 2
    while trie:
        trie, which = divmod(trie, base)
        left = 64 - done
        size = left // (budget + 1)
        low = x & np.uint64((1 << left) - 1)
        by = (which - 1) * size
        if by:
            low = ((low << np.uint64(by)) | (low >> np.uint64(left - by))) & np.uint64((1 << left) - 1)
        x = (x & ~np.uint64((1 << left) - 1)) | low
        done += size
    return x, done


def walk(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of the pairs within the budget, i < j, of the sorted unsigned a within each stretch [start, end).

    A stretch is a node: its values agree in their first `depth` bits.
    """
    al, ah, bl, bh = starts, ends, starts, ends
    err = np.zeros(len(starts), dtype=np.int64)
    for bit in range(63 - depth, -2, -1):
        small = (ah - al) * (bh - bl) <= FEW if bit >= 0 else np.ones(len(al), dtype=bool)
        if small.any():
            yield from _compare(a, al[small], ah[small], bl[small], bh[small], budget)
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            return
        at = np.uint64(1 << bit)
        head = ~np.uint64((1 << (bit + 1)) - 1)
        am, bm = np.searchsorted(a, (a[al] & head) | at), np.searchsorted(a, (a[bl] & head) | at)
        same = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(x[~same] for x in (am, ah, bl, bm, err + 1))]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (err <= budget) & (ah > al) & (bh > bl)
        al, ah, bl, bh, err = (x[keep] for x in (al, ah, bl, bh, err))


def _compare(a, al, ah, bl, bh, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
    n = (ah - al) * (bh - bl)
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP)))
        k = n[lo:hi]
        of = np.repeat(np.arange(lo, hi), k)
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        width = (bh - bl)[of]
        i, j = al[of] + at // width, bl[of] + at % width
        near = (np.bitwise_count(a[i] ^ a[j]) <= budget) & (i < j)
        yield i[near], j[near]
        lo = hi


def node_links(fp: np.ndarray, trie: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst) stars over the distinct fingerprints of one trie; only those under one node meet."""
    x, depth = turned(fp, trie, budget)
    order = np.argsort(x)
    x, fp = x[order], fp[order]
    cut = np.flatnonzero(np.append(True, (x[1:] ^ x[:-1]) >> np.uint64(64 - depth) != 0))
    ends = np.append(cut[1:], len(x))
    some = ends - cut > 1
    labels = np.arange(len(x))
    for i, j in walk(x, cut[some], ends[some], depth, budget):
        link(labels, i, j)
    moved = np.flatnonzero(labels != np.arange(len(x)))
    return fp[moved].view(np.int64), fp[labels[moved]].view(np.int64)


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE) -> DataFrame:
    """(src, dst) stars over distinct fingerprints (column fp): their components are those of all pairs within the budget.

    A row of a trie is (trie, node, fp): node is the fingerprint's leading blocks there. Each row of a node that is to be cut
    is replaced by one for each block of the bits left.
    """
    spark = distinct.sparkSession
    bounded_batches(spark)
    base = budget + 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trie, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for above in np.unique(trie).tolist():
                own = fp[trie == above]
                digits = 0
                while above >= base**digits:
                    digits += 1
                for block in range(1, base):
                    name = above + block * base**digits
                    x, depth = turned(own, name, budget)
                    yield as_batch({"trie": np.full(len(x), name, dtype=np.int32), "node": (x >> np.uint64(64 - depth)).view(np.int64), "fp": own.view(np.int64)})

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        trie, fp = t["trie"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        for name in np.unique(trie).tolist():
            src, dst = node_links(fp[trie == name], name, budget)
            if len(src):
                yield as_batch({"src": src, "dst": dst})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) > WALKED:  # up to where the last node begins
                t = pa.Table.from_batches(held)
                trie, node = t["trie"].to_numpy(), t["node"].to_numpy()
                cuts = np.flatnonzero((trie[1:] != trie[:-1]) | (node[1:] != node[:-1])) + 1
                if len(cuts):
                    yield from work(t.slice(0, int(cuts[-1])))
                    held = t.slice(int(cuts[-1])).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    schema = "trie int, node long, fp long"
    now = distinct.select(F.lit(0).alias("trie"), "fp").mapInArrow(cut, schema)
    done, bits = None, 64 - 64 // (budget + 1)
    while True:
        large = None
        if bits > LEFT_BITS:
            large = materialize(now.groupBy("trie", "node").count().where(F.col("count") > subtree).select("trie", "node"), "simhash-large")
            if not (n := large.count()):
                large = None
        if large is None:
            ready = now
        else:
            side = F.broadcast(large) if n <= BROADCAST_NODES else large
            ready = now.join(side, ["trie", "node"], "left_anti").select("trie", "node", "fp")
        done = ready if done is None else done.unionByName(ready)
        if large is None:
            break
        now = now.join(side, ["trie", "node"], "left_semi").select("trie", "fp").mapInArrow(cut, schema)
        bits -= bits // (budget + 1)
    return in_groups(done, ["trie", "node"], shuffle_partitions(spark), join, "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    Rows link if their fingerprints differ in at most `budget` bits; component_id is the smallest id reachable by links,
    the row's own included. Null or blank texts have the fingerprint 0 and link like any other. Null ids never are a
    component_id, unless a component has no other. Repeated rows come back as often. Other columns don't matter.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, budget))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-names")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 1_000_000) -> DataFrame:
    """The rows of docs whose id is the smallest of its group, one for each group; all columns as they are.

    Rows that repeat both an id and a fingerprint come down to one. Where no row of a group has an id, one row of each
    fingerprint stays. The texts are not shuffled while the ids to drop number at most `broadcast_ids` (8 bytes each),
    else the drop is a shuffled anti-join.
    """
    groups = materialize(simhash_groups(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "simhash-groups")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = materialize(groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(first).alias("first")).where("n > 1 or not first"), "simhash-drop")
    some = by_id.agg(F.count("*"), F.count_if(F.col("first"))).first()

    def ids(df: DataFrame) -> DataFrame:
        df = df.select(F.col("doc_id").alias("__id"))
        return F.broadcast(df) if some[0] <= broadcast_ids else df

    same = F.col(id_col).eqNullSafe(F.col("__id"))
    out = docs.join(ids(by_id), same, "left_anti")
    if some[1]:  # an id on several rows, of which one at least stays
        fp = F.pandas_udf(lambda texts: texts.map(lambda t: np.uint64(fingerprint((t or "").encode())).astype(np.int64)), "long")
        again = docs.join(ids(by_id.where("first")), same, "left_semi").withColumn("__fp", fp(F.col(text_col)))
        stay = groups.where(first).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__stay")).distinct()
        again = again.join(stay, same & (F.col("__fp") == F.col("__stay")), "left_semi").dropDuplicates([id_col, "__fp"]).drop("__fp")
        out = out.unionByName(again)
    return out


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
