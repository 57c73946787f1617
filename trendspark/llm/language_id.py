"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text recognises that sample's substrings. A text is
parsed against it from the left into longest matches (Ziv and Merhav's cross parsing): the state walks on while the
sample has the string so far; where it has not, a phrase ends and the next starts at the root. Few, long phrases mean
that the sample predicts the text. Phrases are weighted by log2 of the sample's length, since a longer sample has longer
matches by chance; the language that needs least per letter wins.

Texts are cut into blocks of BLOCK letters that are parsed side by side (a block's end ends a phrase), so one pass of
array operations serves thousands of blocks and a very long text costs no more than its length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import as_batch, bounded_batches, crc_bucket, free_names

#: The classifier is fitted on at most so many letters of each language, from about so many of its rows. Every language
#: with labelled text is learned: beyond TOTAL_LETTERS / SAMPLE_LETTERS of them each has an equal part of TOTAL_LETTERS,
#: LEAST_LETTERS at least, so that the automata (some 700 bytes a letter) stay bounded.
SAMPLE_LETTERS, SAMPLE_ROWS = 24_000, 400
TOTAL_LETTERS, LEAST_LETTERS = 192_000, 500
BLOCK = 1024
#: The commonest letters of the samples have a code each; all others share OTHER codes by hash. Code 0 is the space.
COMMON, OTHER = 104, 23
WIDTH = 1 + COMMON + OTHER
DEAD = np.int32(1 << 30)
UNKNOWN = "und"


@cache
def _folded() -> np.ndarray:
    """Lower-case code point of each letter; 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letters(text: str) -> np.ndarray:
    """Folded letters of a text, other characters as one 0 between words."""
    x = _folded()[_points(text)]
    keep = x != 0
    keep[1:] |= x[:-1] != 0  # the first of a run of other characters
    return x[keep]


class Codes:
    """Codes of letters: dense for the commonest of the samples, hashed for the rest, so any script has codes."""

    def __init__(self, common: np.ndarray) -> None:
        self.common = np.sort(common.astype(np.uint32))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.where(x == 0, 0, 1 + COMMON + x % OTHER).astype(np.uint8)
        at = np.minimum(np.searchsorted(self.common, x), len(self.common) - 1)
        return np.where(x == 0, 0, np.where(self.common[at] == x, 1 + at, 1 + COMMON + x % OTHER)).astype(np.uint8)

    def table(self) -> np.ndarray:
        return self(_folded())


def suffix_automaton(codes: np.ndarray) -> np.ndarray:
    """Transitions [state * WIDTH + code] of the suffix automaton of the codes, by Blumer's online construction.

    A missing transition holds the root's transition for the code (the root where it has none) plus DEAD.
    """
    size = 2 * len(codes) + 2
    to = np.full((size, WIDTH), -1, dtype=np.int32)
    link, length = [-1] * size, [0] * size
    last, n = 0, 1
    for c in codes.tolist():
        cur, n = n, n + 1
        length[cur] = length[last] + 1
        p = last
        while p >= 0 and to[p, c] < 0:
            to[p, c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        elif length[q := int(to[p, c])] == length[p] + 1:
            link[cur] = q
        else:
            clone, n = n, n + 1
            length[clone] = length[p] + 1
            to[clone] = to[q]
            link[clone] = link[q]
            while p >= 0 and to[p, c] == q:
                to[p, c] = clone
                p = link[p]
            link[q] = link[cur] = clone
        last = cur
    to = to[:n]
    root = np.where(to[0] < 0, 0, to[0])
    return np.where(to < 0, root | DEAD, to).astype(np.int32)


def phrases(to: np.ndarray, blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each row of blocks [position, block], whose lengths descend."""
    flat = to.reshape(-1)
    state = np.zeros(len(lengths), dtype=np.int32)
    count = np.zeros(len(lengths), dtype=np.int32)
    active = np.searchsorted(-lengths, -np.arange(blocks.shape[0]), side="left")  # blocks longer than each position
    for j, k in enumerate(active.tolist()):
        if not k:
            break
        v = flat[state[:k] * WIDTH + blocks[j, :k]]
        dead, then = v >= DEAD, v & (DEAD - 1)
        count[:k] += dead
        count[:k] += dead & (then == 0) & (state[:k] > 0)  # a letter that the sample has nowhere is a phrase of its own
        state[:k] = then
    return count + (state > 0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", letters_each: int = SAMPLE_LETTERS) -> tuple[list[str], list[np.ndarray], Codes]:
    """Languages, their automata and the letter codes, learned from the rows with a text and a label.

    The sample of a language: its rows in the order of a hash of the id, as many as give `letters_each` letters (fewer
    each if the languages are many, see TOTAL_LETTERS); rows are drawn by a hash threshold that expects SAMPLE_ROWS of each.
    """
    spark, span = docs.sparkSession, 1 << 40
    bounded_batches(spark)
    lang, h = F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h")
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(lang, h, F.col(text_col).cast("string").alias("text"))
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    each = min(letters_each, max(LEAST_LETTERS, TOTAL_LETTERS // max(1, len(sizes))))
    limits = [(r["lang"], int(min(1.0, SAMPLE_ROWS / r["count"]) * span)) for r in sizes]
    chosen = rows.join(F.broadcast(spark.createDataFrame(limits, "lang string, most long")), "lang").where(F.pmod("h", F.lit(span)) <= F.col("most"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield as_batch({"lang": b.column(0), "h": b.column(1), "x": pa.array([letters(t)[:each].tobytes() for t in b.column(2).to_pylist()], pa.binary())})

    got: dict[str, list] = {r["lang"]: [] for r in sizes}
    for r in chosen.select("lang", "h", "text").mapInArrow(cut, "lang string, h long, x binary").toLocalIterator():
        got[r["lang"]].append((r["h"], np.frombuffer(bytes(r["x"]), dtype=np.uint32)))
    samples = {}
    for lang in sorted(got):
        parts, n = [], 0
        for _, x in sorted(got[lang], key=lambda hx: (hx[0], hx[1].tobytes())):
            parts.append(np.append(x, np.uint32(0)))
            n += len(x)
            if n >= each:
                break
        joined = np.concatenate(parts)[:each] if parts else np.zeros(0, dtype=np.uint32)
        if (joined != 0).any():
            samples[lang] = joined
    everything = np.concatenate(list(samples.values())) if samples else np.zeros(0, dtype=np.uint32)
    seen, n = np.unique(everything[everything != 0], return_counts=True)
    codes = Codes(seen[np.lexsort((seen, -n))][:COMMON])
    return list(samples), [suffix_automaton(codes(x)) for x in samples.values()], codes


def _predict(texts: list[str | None], languages: list[str], automata: list[np.ndarray], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    points = [_points(t or "") for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    whole = np.concatenate(points) if points else np.zeros(0, dtype=np.uint32)
    code = table[whole]
    keep = code != 0
    n_letters = np.bincount(doc[keep], minlength=len(texts))
    keep[1:] |= (code[:-1] != 0) & (doc[1:] == doc[:-1])
    code, doc = code[keep], doc[keep]
    per_doc = np.bincount(doc, minlength=len(texts))
    n_blocks = -(-per_doc // BLOCK)
    of = np.repeat(np.arange(len(texts)), n_blocks)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    lengths = np.minimum(BLOCK, per_doc[of] - nth * BLOCK)
    starts = (np.cumsum(per_doc) - per_doc)[of] + nth * BLOCK
    order = np.argsort(-lengths, kind="stable")
    lengths, starts, of = lengths[order], starts[order], of[order]
    blocks = np.zeros((int(lengths.max(initial=0)), len(lengths)), dtype=np.uint8)
    step = np.arange(blocks.shape[0])
    for lo in range(0, len(lengths), 256):  # gathered in slices, to keep the index small
        at = starts[lo : lo + 256, None] + step[None]
        blocks[:, lo : lo + 256] = code[np.minimum(at, len(code) - 1)].T if len(code) else 0
    cost = np.zeros((len(languages), len(texts)))
    for i, to in enumerate(automata):
        c = np.bincount(of, phrases(to, blocks, lengths), minlength=len(texts)) if len(of) else np.zeros(len(texts))
        cost[i] = c * np.log2(max(2, len(to) / 2)) / np.maximum(1, per_doc)
    if not languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best = cost.argmin(axis=0)  # on ties the first name
    low = cost.min(axis=0)
    rest = np.partition(cost, 1, axis=0)[1] if len(languages) > 1 else np.full(len(texts), np.inf)
    some = n_letters > 0
    score = np.where(some, 1.0 - np.divide(low, rest, out=np.zeros_like(low), where=np.isfinite(rest) & (rest > 0)) / 2, 0.0)
    return [languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score, np.where(some, low, 0.0)


#: A text of at least FOREIGN_LETTERS characters that costs over FOREIGN_BITS a letter in every language is in none of them:
#: texts of a learned language cost 2 to 4, letters at random 5, letters that no sample has 10 and more.
FOREIGN_BITS, FOREIGN_LETTERS = 8.0, 200
ADDED = ("lang_pred", "lang_score", "lang_bits")


def identify(
    docs: DataFrame,
    model: tuple[list[str], list[np.ndarray], Codes],
    id_col: str = "doc_id",
    text_col: str = "text",
    names: tuple[str, str, str] = ADDED,
) -> DataFrame:
    """docs and the columns lang_pred, lang_score and lang_bits (cost in bits a letter), or `names`; one row for each row.

    lang_pred is `und` with the score 0 where the text is null, has no letter or nothing was learned. The score is
    1 - best / (2 * second best), so 1/2 where two languages tie (the first name wins) and 1 if only one was learned.
    Columns of docs with those three names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    languages, automata, codes = model
    shared = spark.sparkContext.broadcast((languages, automata, codes))  # bounded by TOTAL_LETTERS
    kept = docs.drop(*names)
    at = kept.columns.index(text_col)
    tables: dict[int, np.ndarray] = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, automata, codes = shared.value
        if not tables:
            tables[0] = codes.table()
        for b in batches:
            found = _predict(b.column(at).to_pylist(), languages, automata, tables[0])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found)], names=[*b.schema.names, *names])

    types = (T.StringType(), T.DoubleType(), T.DoubleType())
    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, *(T.StructField(k, t) for k, t in zip(names, types, strict=True))]))


def accepted(docs: DataFrame, model: tuple[list[str], list[np.ndarray], Codes], languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs in one of the languages (None: any that was learned); columns as they are, whatever their names.

    Rejected: null texts, texts without a letter, and long ones of letters or sequences that no language has.
    """
    names = tuple(free_names(docs, *ADDED))
    found = identify(docs, model, text_col=text_col, names=names)
    pred, _, bits = (F.col(k) for k in names)
    foreign = (bits > FOREIGN_BITS) & (F.length(text_col) >= FOREIGN_LETTERS)
    keep = pred.isin(languages) if languages is not None else pred != UNKNOWN
    return found.where(keep & ~foreign).select(*docs.columns)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_bucket(F.col("doc_id"), 4) != 2)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_bits")
