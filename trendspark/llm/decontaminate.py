"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark.

The automaton's symbols are words: each benchmark word has a number, and any other word leads to the root, as no window
holds it. So a text is scanned once, and only its stretches of benchmark words need to walk the automaton. An automaton
is built from at most WINDOW_WORDS words of windows (or one item) and kept by a worker from task to task. A benchmark is
read item by item; one that takes several automata gets a round over the texts for each, whose hits are written out and
carried on, so that only one is held at a time, by the driver and by a worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import bounded_batches, free_names, text_bytes
from trendspark.session import materialize

WINDOW = 13
WINDOW_WORDS = 2_000_000
#: Bytes that are not of a word become spaces, A-Z become a-z. All bytes of other characters are word bytes.
_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
ADDED = ("n_words", "n_hit", "items", "spans")
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_TYPES = (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(_SPAN))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class Matcher:
    """The automaton of the windows of (item, words) pairs; finds the hit words and the items in a list of words."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, words in items:
            for w in windows([self.number.setdefault(x, len(self.number) + 1) for x in words]):
                found.setdefault(w, set()).add(item)
        self.shortest = min((len(w) for w in found), default=1)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, owners in found.items():
            self.auto.add_word(w, (len(w), owners))
        if found:
            self.auto.make_automaton()
        self.empty = not found

    def __call__(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        if self.empty or not words:
            return
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                for end, (n, owners) in self.auto.iter(tuple(ids[a:b].tolist())):
                    hit[a + end - n + 1 : a + end + 1] = True
                    items |= owners


#: A worker's automaton, kept from task to task, by the name of its group of items.
_held: dict[str, Matcher] = {}


def matcher(key: str, items: list[tuple[int | None, list[bytes]]]) -> Matcher:
    if key not in _held:
        _held.clear()
        _held[key] = Matcher(items)
    return _held[key]


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code points [start, end) of the stretches of hit words in the original text."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.array([bytes([b]) != b" " for b in _FOLD], dtype=bool)
    word = (x >= 128) | table[np.minimum(x, 127)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word, [0]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(run[::2], run[1::2], strict=True)]


def item_groups(benchmark: DataFrame, item_col: str, item_text: str, most_words: int) -> Iterator[tuple[list, bool]]:
    """Groups of (item, words) with at most most_words words of windows each, or of one item, and whether it is the last."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").orderBy("i", "t")
    group, size = [], 0
    for r in rows.toLocalIterator():
        words = words_of(r["t"].encode())
        cost = len(words) if len(words) <= WINDOW else (len(words) - WINDOW + 1) * WINDOW
        if group and size + cost > most_words:
            yield group, False
            group, size = [], 0
        group.append((r["i"], words))
        size += cost
    yield group, True


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    most_words: int = WINDOW_WORDS,
    names: tuple[str, str, str, str] = ADDED,
) -> DataFrame:
    """docs and n_words, n_hit, items (ids with an occurring window) and spans (code points of hit stretches), or `names`.

    One row for each row; columns with these names are replaced. A null or blank text has no words and no hits; a null
    benchmark text is no item; a repeated item counts once. Windows: `WINDOW` words in a row, or all of a shorter item.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.drop(*names)
    at = kept.columns.index(text_col)
    hit_col, item_col_ = free_names(kept, "hit", "found")
    carried = T.StructType([*kept.schema.fields, T.StructField(hit_col, T.BinaryType()), T.StructField(item_col_, T.ArrayType(T.LongType()))])
    final = T.StructType([*kept.schema.fields, *(T.StructField(k, t) for k, t in zip(names, _TYPES, strict=True))])
    width = len(kept.columns)

    def scan(group: list, last: bool):  # noqa: ANN202
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(group)  # most_words words of windows, or one item

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = matcher(key, shared.value)
            for b in batches:
                before = [b.column(k).to_pylist() for k in (width, width + 1)] if b.num_columns > width else None
                n_words, n_hit, hits, items, spans = [], [], [], [], []
                for i, text in enumerate(text_bytes(b.column(at))):
                    words = words_of(text)
                    hit, found = np.zeros(len(words), dtype=bool), set()
                    if before:
                        hit |= np.unpackbits(np.frombuffer(before[0][i], dtype=np.uint8), count=len(words)).astype(bool)
                        found.update(before[1][i])
                    match(words, hit, found)
                    items.append(sorted(x for x in found if x is not None) + [None] * (None in found))
                    if last:
                        n_words.append(len(words))
                        n_hit.append(int(hit.sum()))
                        spans.append(_spans(b.column(at)[i].as_py(), hit) if found else [])
                    else:
                        hits.append(np.packbits(hit).tobytes())
                own = b.columns[:width]
                listed = pa.array(items, pa.list_(pa.int64()))
                if last:
                    where = pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), listed, where], names=final.names)
                else:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(hits, pa.binary()), listed], names=carried.names)

        return work

    now = kept
    for group, last in item_groups(benchmark, item_col, item_text, most_words):
        now = now.mapInArrow(scan(group, last), final if last else carried)
        if not last:
            now = materialize(now, "hits")
    return now


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated; columns as they are, whatever their names."""
    names = tuple(free_names(docs, *ADDED))
    found = find_contamination(docs, benchmark, text_col, names=names)
    return found.where(~contaminated(names[1], names[0])).select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs.select("doc_id", "text"), bench)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
