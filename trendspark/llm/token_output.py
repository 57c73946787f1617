"""Token ids as binary shards with Elias-Fano coded document boundaries.

Documents are tokenised, dealt by ranges of doc_id, and written in ascending order: a shard holds the ids of its documents
one after the other, and the offsets at which documents start and the doc_ids, both as Elias-Fano sequences. A sequence
of n values below u takes about 2 + log2(u / n) bits a value: the low bits as they are, the high bits in unary, with the
place of each SAMPLE-th one kept, from which a value is selected without a table of 64-bit offsets.

Shard: MAGIC, then little-endian unsigned 64-bit n_docs, n_null (documents without id, first), n_ids, width of an id in
bytes, least doc_id (signed), and the byte lengths of five parts: ids, and low, high of offsets, low, high of doc_ids;
then the parts. The low bits start with a byte that holds their number for each value. The places of the sampled ones are rebuilt when a shard is opened.

Shards are written next to their final place and renamed, so a lost or repeated task leaves whole files only.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.llm.common import as_batch, bounded_batches, runs
from trendspark.session import materialize, scratch_path

MAGIC = b"EFTOK\x01\x00\x00"
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Documents of a range of ids, and ids of a shard, at most (one document may be longer).
RANGE_DOCS, SHARD_IDS = 8192, 8 << 20
#: Words an encoder remembers, and their characters: some 60 MB of a worker with what they stand in.
CACHED_WORDS, CACHED_BYTES = 400_000, 24 << 20
BETWEEN = "\x01"
#: Bits of the high part for each number of the select directory, and documents whose offsets are selected at once.
BLOCK, SELECT_DOCS = 512, 4096
#: Ranges of ids at most, so that cuts and totals of ranges stay bounded; a larger table has larger ranges.
MAX_RANGES = 20_000


class EliasFano:
    """A non-decreasing sequence of integers from 0 below 2**63: get(i) selects one value, some(a, b) selects a stretch.

    Select looks up the number of ones before each block of BLOCK bits of the high part (a 32-bit number for each block), so
    only the blocks that hold the wanted ones are unpacked.
    """

    def __init__(self, n: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low, self.high = n, low[1:], high
        self.bits = int(low[0]) if n else 0
        step = BLOCK // 8
        whole = np.pad(np.bitwise_count(high), (0, -len(high) % step)).reshape(-1, step)
        self.before = np.concatenate([[0], np.cumsum(whole.sum(axis=1, dtype=np.int64))]).astype(np.uint32)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(values)
        if not n:
            return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8)
        v = values.astype(np.uint64)
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.zeros(0, dtype=np.uint8)
        if width:
            places = np.arange(width, dtype=np.uint64)
            pieces = [((v[a : a + 65_536, None] >> places) & np.uint64(1)).astype(np.uint8) for a in range(0, n, 65_536)]
            # Each value's bits are contiguous; 65,536 values of any width end on a byte.
            low = np.concatenate([np.packbits(p.reshape(-1), bitorder="little") for p in pieces])
        low = np.concatenate([np.array([width], dtype=np.uint8), low])
        high = np.zeros((int(v[-1]) >> width) + n, dtype=np.uint8)
        high[(v >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        return low, np.packbits(high, bitorder="little")

    def _low(self, a: int, b: int) -> np.ndarray:
        w = self.bits
        if not w:
            return np.zeros(b - a, dtype=np.uint64)
        first = a * w // 8
        raw = np.unpackbits(self.low[first : -(-b * w // 8)], bitorder="little")[a * w - first * 8 :][: (b - a) * w]
        return (raw.reshape(-1, w).astype(np.uint64) << np.arange(w, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def some(self, a: int, b: int) -> np.ndarray:
        """The values from the a-th to before the b-th."""
        if a >= b:
            return np.zeros(0, dtype=np.int64)
        first, last = np.searchsorted(self.before, [a, b - 1], side="right") - 1
        ones = np.flatnonzero(np.unpackbits(self.high[first * BLOCK // 8 : (last + 1) * BLOCK // 8], bitorder="little"))
        skip = a - int(self.before[first])
        place = ones[skip : skip + b - a] + int(first) * BLOCK
        return (((place - np.arange(a, b)).astype(np.uint64) << np.uint64(self.bits)) | self._low(a, b)).astype(np.int64)

    def get(self, i: int) -> int:
        return int(self.some(i, i + 1)[0])


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The shard of documents in ascending order of id, nulls first, with counts of ids and all ids."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    offsets = np.concatenate([[0], np.cumsum(counts)])
    parts = [ids.tobytes(), *(x.tobytes() for x in EliasFano.encode(offsets)), *(x.tobytes() for x in EliasFano.encode(known.view(np.uint64) - np.int64(least).view(np.uint64)))]
    head = np.array([len(doc_ids), nulls, len(ids), ids.dtype.itemsize, np.int64(least).view(np.uint64), *map(len, parts)], dtype="<u8")
    return MAGIC + head.tobytes() + b"".join(parts)


class Shard:
    """A shard's documents: ids(i) selects one, without decoding the others."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        head = np.frombuffer(data, "<u8", 10, 8)
        self.n_docs, self.n_null, self.n_ids, width = map(int, head[:4])
        self.least, at, parts = int(head[4:5].view("<i8")[0]), 88, []
        for k in head[5:].tolist():
            parts.append(np.frombuffer(data, np.uint8, k, at))
            at += k
        self.flat = parts[0].view(f"<u{width}")
        self.offsets = EliasFano(self.n_docs + 1, parts[1], parts[2])
        self.known = EliasFano(self.n_docs - self.n_null, parts[3], parts[4])

    def ids(self, i: int) -> np.ndarray:
        a, z = self.offsets.some(i, i + 2).tolist()
        return self.flat[a:z]

    def doc_ids(self, a: int, b: int) -> pa.Array:
        """The ids of the documents from the a-th to before the b-th, nulls first."""
        nulls = max(0, min(b, self.n_null) - a)
        known = self.known.some(max(0, a - self.n_null), max(0, b - self.n_null)) + self.least
        return pa.array(np.concatenate([np.zeros(nulls, dtype=np.int64), known]), mask=np.arange(b - a) < nulls)


class Encoder:
    """Ids of texts. Words between spaces and line ends are encoded once and remembered, CACHED_WORDS at most.

    That gives the ids of whole texts for tokenizers that drop white space and never look across it; `whole` doesn't
    rely on it. New words are encoded many at a time, with a control character between them whose id is found again.
    """

    def __init__(self, path: str, whole: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of known words
        # For ASCII texts this normaliser only folds A-Z, which str.lower does sooner and for whole texts at once.
        plain = json.loads(self.tokenizer.to_str())
        folds = [n["type"] for n in (plain.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.ascii = Tokenizer.from_str(json.dumps(plain | {"normalizer": None})) if folds else None
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if BETWEEN in w] if len(self.between) == 1 else words
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype=self.dtype).tobytes()
        rest = [w for w in words if BETWEEN not in w] if len(self.between) == 1 else []
        low = [w for w in rest if w.isascii() and w == w.lower()] if self.ascii else []
        self._learn_groups(self.ascii, low)
        self._learn_groups(self.tokenizer, list(set(rest).difference(low)))

    def _learn_groups(self, tokenizer, words: list[str]) -> None:  # noqa: ANN001
        groups = [words[i : i + 32] for i in range(0, len(words), 32)]
        if not groups:
            return
        for group, e in zip(groups, tokenizer.encode_batch_fast([f" {BETWEEN} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = [*np.flatnonzero(ids == self.between[0]).tolist(), len(ids)]
            data, width, a = ids.tobytes(), self.dtype.itemsize, 0
            for w, z in zip(group, ends, strict=True):
                self.known[w] = data[a * width : z * width]
                a = z + 1

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if self.whole:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for lo in range(0, len(texts), 64):
            some = texts[lo : lo + 64]
            if self.ascii:
                some = [t.lower() if t.isascii() and "<|" not in t else t for t in some]  # special tokens are told by case
            words = [t.replace("\n", " ").split(" ") for t in some]
            new = set().union(*words).difference(self.known)
            self._learn(list(new))
            out += [b"".join(map(self.known.__getitem__, ws)) for ws in words]
            self.held += sum(map(len, new))
            if len(self.known) > CACHED_WORDS or self.held > CACHED_BYTES:  # what came first is the commonest, by and large
                self.known = dict(islice(((w, x) for w, x in self.known.items() if len(w) <= 40), CACHED_WORDS // 2))
                self.held = sum(map(len, self.known))
        return out


#: A worker's encoders, kept from task to task.
_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, whole: bool) -> Encoder:
    if (path, whole) not in _encoders:
        _encoders[path, whole] = Encoder(path, whole)
    return _encoders[path, whole]


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_ids: int = SHARD_IDS,
    whole: bool = False,
) -> DataFrame:
    """Writes the shards of docs to the folder; returns (part, seq, path, n_docs, n_ids, start), start: ids in earlier shards.

    A null text is empty: its document has the end id alone. Null ids come first. Repeated ids are documents of their own, in the
    order of their ids' bytes. Other columns are not written. No document, no shard. `whole`: see Encoder. Ranges of ids hold
    RANGE_DOCS documents, or more beyond MAX_RANGES of them; the list of shards is a table, and only the totals of ranges
    pass through the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = min(MAX_RANGES, max(1, -(-rows.count() // RANGE_DOCS)))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    edges = spark.sparkContext.broadcast(np.array(cuts, dtype=np.int64))  # MAX_RANGES at most

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, whole)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for b in batches:
            doc = b.column(0)
            part = np.searchsorted(edges.value, doc.fill_null(-(2**63)).to_numpy(), side="right")
            ids = [x + end for x in encoder([t or "" for t in b.column(1).to_pylist()])]
            yield as_batch({"part": part.astype(np.int32), "doc_id": doc, "ids": pa.array(ids, pa.binary())})

    width = Encoder(tokenizer).dtype.itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, seq, last = [], 0, None

        def flush(part: int, seq: int, doc_ids: list, chunks: list[bytes]) -> None:
            counts = np.array([len(c) // width for c in chunks], dtype=np.int64)
            path = f"{root}/part-{part:08d}-{seq:05d}.eftok"
            draft = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(shard_bytes(doc_ids, counts, np.frombuffer(b"".join(chunks), dtype=f"<u{width}")))
            store.move(draft, path)
            out.append((part, seq, f"{folder.rstrip('/')}/{os.path.basename(path)}", len(doc_ids), int(counts.sum())))

        doc_ids, chunks, size = [], [], 0
        for b in batches:
            for part, d, ids in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if doc_ids and (part != last or size + len(ids) > shard_ids * width):
                    flush(last, seq, doc_ids, chunks)
                    doc_ids, chunks, size, seq = [], [], 0, seq + 1 if part == last else 0
                elif part != last:
                    seq = 0
                last = part
                doc_ids.append(d)
                chunks.append(ids)
                size += len(ids)
        if doc_ids:
            flush(last, seq, doc_ids, chunks)
        yield as_batch({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())))})

    dealt = rows.mapInArrow(tokenise, "part int, doc_id long, ids binary").repartitionById(len(cuts) + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    shards = materialize(dealt.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "shards")
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # MAX_RANGES at most
    before = np.concatenate([[0], np.cumsum([k for _, k in sums], dtype=np.int64)]).tolist()
    starts = spark.createDataFrame([(p, at) for (p, _), at in zip(sums, before, strict=False)], "part int, before long")
    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + earlier).drop("before")


def read_tokens(spark: SparkSession, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; with_ids: and ids as array<int>.

    Offsets and doc_ids are selected from their Elias-Fano sequences, SELECT_DOCS documents at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    shard = Shard(f.read())
                for a in range(0, shard.n_docs, SELECT_DOCS):
                    z = min(a + SELECT_DOCS, shard.n_docs)
                    at = shard.offsets.some(a, z + 1)
                    ids = shard.flat[at[0] : at[-1]].astype("<u4")
                    cuts = (at - at[0]).tolist()
                    crc = [zlib.crc32(ids[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                    made = {"doc_id": shard.doc_ids(a, z), "start": start + at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())}
                    yield as_batch(made | ({"ids": pa.ListArray.from_arrays(np.array(cuts, dtype=np.int32), ids.astype(np.int32))} if with_ids else {}))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    listed = shards.select("path", "start")
    return listed.repartition(max(1, min(shards.count(), MAX_RANGES))).mapInArrow(work, schema)


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    shards = write_tokens(docs, scratch_path(spark, "tokens"), public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, shards)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
