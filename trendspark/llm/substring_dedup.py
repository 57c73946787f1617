"""Removal of passages that recur in a corpus, by repeated-phrase automata over blocks of documents.

A window is WINDOW words in a row. Recurring ones are confirmed without sending every window through a shuffle:

1. Anchors. The least hash among the runs of ANCHOR words of a window is its anchor, so equal windows have equal anchors
   at equal places. Each document names its anchors; an anchor that occurs once in the corpus clears its windows.
2. Stretches. What is left of a document are stretches of windows whose anchors recur; equal ones collapse with a count.
3. Confirmation. The windows of the distinct stretches are counted by 128 bits of hash. A window that occurs once has one
   row, so its place is the minimum of its places: it comes back without a join. The runs of the others are the passages.
4. Automata. Each block of documents gets the distinct passages of its stretches, compiled to one Aho-Corasick automaton
   over the spaced text (a shard); the documents of the block stream through it, and every occurrence is marked.

The texts are written once, bucketed by block, so that steps 2 and 4 read them without a shuffle. A block holds at most
BLOCK_BYTES of text or one document, and bounds what a worker holds; a passage is sent once to each block that has it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import as_batch, bounded_batches, free_names, shuffle_partitions, slices, text_bytes
from trendspark.llm.textstats import mix
from trendspark.session import materialize, scratch_path

WINDOW, ANCHOR = 35, 12
BLOCK_BYTES = 4 << 20
ADDED = ("n_words", "n_removed", "kept_text", "removed_spans")
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_TYPES = (T.LongType(), T.LongType(), T.StringType(), T.ArrayType(_SPAN))
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def hashes(words: list[bytes], seed: int) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = {w: xxhash.xxh3_64_intdigest(w, seed) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of each n words in a row, by doubling."""
    m = max(0, len(h) - n + 1)
    out, done = np.zeros(m, dtype=np.uint64), 0
    power, size, weight = h, 1, base
    while True:
        if n & size:
            out = out * weight + power[done : done + m]
            done += size
        if size * 2 > n:
            return mix(out)
        power = power[:-size] * weight + power[size:]
        size, weight = size * 2, np.uint64(int(weight) ** 2 & (1 << 64) - 1)


def sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least, or the largest, of each n values in a row."""
    pick = np.minimum if least else np.maximum
    size = 1
    while size * 2 <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Windows:
    """The windows of some texts: words, the text of each word, and of each window whether it is one and its anchor."""

    def __init__(self, texts: list[bytes]) -> None:
        parts = [t.split() for t in texts]
        self.n = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.words = [w for p in parts for w in p]
        self.text = np.repeat(np.arange(len(parts)), self.n)
        self.first = np.cumsum(self.n) - self.n
        m = max(0, len(self.words) - WINDOW + 1)
        self.whole = self.text[:m] == self.text[WINDOW - 1 :] if m else np.zeros(0, dtype=bool)
        if m:
            self.gram = grams(hashes(self.words, 0), ANCHOR, _BASES[0])
            self.anchor = sliding(self.gram, WINDOW - ANCHOR + 1, True)

    def anchors(self) -> list[np.ndarray]:
        """Of each text its anchors, one that it has at several places twice."""
        out = [np.zeros(0, dtype=np.uint64)] * len(self.n)
        if not self.whole.any():
            return out
        span = WINDOW - ANCHOR + 1
        pad = np.zeros(span - 1, dtype=np.uint64)
        highest = sliding(np.concatenate([pad, np.where(self.whole, self.anchor, 0), pad]), span, False)
        at = np.flatnonzero((self.gram == highest) & (highest > 0))
        text, value = self.text[at], self.gram[at]
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        third = np.zeros(len(at), dtype=bool)
        third[2:] = (text[2:] == text[:-2]) & (value[2:] == value[:-2])
        text, value = text[~third], value[~third]
        for k, some in zip(np.unique(text).tolist(), np.split(value, np.flatnonzero(np.diff(text)) + 1), strict=True):
            out[k] = some
        return out

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of hash of each window, as two numbers."""
        return tuple(grams(hashes(self.words, k + 1), WINDOW, _BASES[k]) for k in (0, 1))

    def runs(self, marked: np.ndarray) -> Iterator[tuple[int, int]]:
        """Words [start, end) of the longest runs of marked windows of a text."""
        marked = marked & self.whole
        edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).view(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            # Runs of two texts never touch: between them lie windows that are not whole.
            yield a, b + WINDOW - 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _blocks(docs: DataFrame, text_col: str, block: str, anchors: str) -> DataFrame:
    """docs with a block and the anchors of each text, written bucketed by block."""
    spark = docs.sparkSession
    at, most = docs.columns.index(text_col), BLOCK_BYTES
    schema = T.StructType([*docs.schema.fields, T.StructField(block, T.LongType()), T.StructField(anchors, T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size = None, 0
        for b in batches:
            texts, done, own, found = text_bytes(b.column(at)), 0, [], []
            for some in slices(texts):
                rows = b.column(b.num_columns - 1)[done : done + len(some)].to_pylist()
                for row, t in zip(rows, some, strict=True):
                    if now is None or size + len(t) > most:
                        now, size = row, 0
                    size += len(t)
                    own.append(now)
                found += Windows(some).anchors()
                done += len(some)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.int64()), _lists(found)], names=schema.names)

    cut_up = docs.withColumn(block, F.monotonically_increasing_id()).mapInArrow(cut, schema)
    name = f"texts_{uuid.uuid4().hex}"
    cut_up.write.format("parquet").bucketBy(shuffle_partitions(spark), block).option("path", scratch_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def _stretches(texts: pa.Table, once: pa.Table) -> pa.Table:
    """The distinct stretches of a block's texts whose anchors are not among those that occur once."""
    single = np.sort(once.column(1).to_numpy().view(np.uint64))
    found: Counter[bytes] = Counter()
    for some in slices(text_bytes(texts.column(1))):
        w = Windows(some)
        if not w.whole.any():
            continue
        at = np.searchsorted(single, w.anchor)
        clear = single[np.minimum(at, len(single) - 1)] == w.anchor if len(single) else np.zeros(len(w.anchor), dtype=bool)
        for a, b in w.runs(~clear):
            found[b" ".join(w.words[a:b])] += 1
    block = texts.column(0)[0].as_py()
    return pa.table({
        "block": pa.array([block] * len(found), pa.int64()),
        "name": pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary()),
        "n": pa.array(list(found.values()), pa.int64()),
        "stretch": pa.array(list(found), pa.binary()).cast(pa.string()),
    })


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of stretches: their names, the stretch's count, the stretch and the place in it."""
    for b in batches:
        done = 0
        for some in slices(text_bytes(b.column(2))):
            w = Windows(some)
            at = np.flatnonzero(w.whole)
            of = w.text[at]
            sid, n = (b.column(k).to_numpy()[done : done + len(some)] for k in (0, 1))
            high, low = (x[at].view(np.int64) for x in w.names())
            yield as_batch({"high": high, "low": low, "n": n[of], "sid": sid[of], "place": at - w.first[of]})
            done += len(some)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch the runs of its windows that are not holes."""
    for b in batches:
        out, holes = [], b.column(2).to_pylist()
        for i, text in enumerate(text_bytes(b.column(1))):
            if not holes[i]:
                out.append([text])
                continue
            w = Windows([text])
            marked = np.ones(len(w.whole), dtype=bool)
            marked[holes[i]] = False
            out.append(list(dict.fromkeys(b" ".join(w.words[x:y]) for x, y in w.runs(marked))))
        yield as_batch({"name": b.column(0), "passages": pa.array(out, pa.list_(pa.binary())).cast(pa.list_(pa.string()))})


class Locator:
    """The automaton of passages; marks the words of a text that any of their occurrences covers."""

    def __init__(self, passages: list[str]) -> None:
        self.auto = ahocorasick.Automaton()
        for p in passages:
            self.auto.add_word(f" {p} ", p.count(" ") + 1)
        self.empty = not passages
        if passages:
            self.auto.make_automaton()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Whether each word is covered."""
        if self.empty or len(words) < WINDOW:
            return np.zeros(len(words), dtype=bool)
        spaced = b" " + b" ".join(words) + b" "
        hits = list(self.auto.iter(spaced.decode()))
        if not hits:
            return np.zeros(len(words), dtype=bool)
        ends, n = (np.array(x, dtype=np.int64) for x in zip(*hits, strict=True))
        sizes = np.fromiter((len(w.decode()) for w in words), dtype=np.int64, count=len(words))
        after = np.searchsorted(np.cumsum(sizes + 1), ends) + 1  # words up to the end of each occurrence
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, after - n, 1)
        np.add.at(change, after, -1)
        return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, text_col: str = "text", names: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """docs and n_words, n_removed, kept_text (words joined by one space) and removed_spans (of words, end exclusive).

    A word goes if a window over it has a word sequence that also starts anywhere else, in its own document, another or a
    repeated row; all windows are judged on the input. One row for each row, repeated rows included; columns with these
    names are replaced. A null or blank text has no words and an empty kept_text; one of fewer than WINDOW words stays.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*names)
    block, anchors = free_names(docs, "block", "anchors")
    texts = _blocks(docs, text_col, block, anchors)
    each = texts.select(F.col(block).alias("block"), F.explode(anchors).alias("anchor"))
    once = each.groupBy("anchor").agg(F.count("*").alias("c"), F.min("block").alias("block")).where("c = 1").select("block", "anchor")
    by_block = texts.select(F.col(block).alias("block"), F.col(text_col).alias("text")).groupBy("block")
    stretches = by_block.cogroup(once.groupBy("block")).applyInArrow(_stretches, "block long, name binary, n long, stretch string")
    stretches = materialize(stretches, "stretches")
    distinct = stretches.groupBy("name").agg(F.sum("n").alias("n"), F.any_value("stretch").alias("stretch")).withColumn("sid", F.monotonically_increasing_id())
    distinct = materialize(distinct, "distinct-stretches")
    seen = distinct.select("sid", "n", "stretch").mapInArrow(_windows, "high long, low long, n long, sid long, place long")
    counted = seen.groupBy("high", "low").agg(F.sum("n").alias("c"), F.min("sid").alias("sid"), F.min("place").alias("place"))
    holes = counted.where("c = 1").groupBy("sid").agg(F.collect_list("place").alias("holes"))
    passages = distinct.join(holes, "sid", "left").select("name", "stretch", "holes").mapInArrow(_passages, "name binary, passages array<string>")
    routed = stretches.select("block", "name").join(passages, "name").select("block", F.explode("passages").alias("passage"))

    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in zip(names, _TYPES, strict=True))])
    at, kept = docs.columns.index(text_col), len(docs.columns)

    def locate(rows: pa.Table, found: pa.Table) -> pa.Table:
        locator = Locator(list(dict.fromkeys(found.column(1).to_pylist())))
        n_words, n_removed, left, spans = [], [], [], []
        for text in text_bytes(rows.column(at)):
            words = text.split()
            gone = locator(words)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8))).tolist()
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            left.append(b" ".join(words if not edge else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        where = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        added = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string()), where]
        return pa.Table.from_arrays([*rows.columns[:kept], *added], names=schema.names)

    rows = texts.select(*docs.columns, block)
    return rows.groupBy(block).cogroup(routed.groupBy("block")).applyInArrow(locate, schema)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
