"""Document quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, ICML 2018).

A document is a bag of passages of PASSAGE words. A passage is encoded from its hashed words and its shapes of characters;
gated attention, learned from document labels alone, weighs the passages, and the weighted sum of their encodings is
scored. The model is fitted on a bounded sample of labelled rows; every passage of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import as_batch, bounded_batches, crc_bucket, slices, text_bytes
from trendspark.llm.textstats import CLASSES, words_of

PASSAGE, BUCKETS, FINE = 128, 128, 512
#: The model is fitted on at most so many labelled rows, a hash of whose ids is lowest, and on so many passages of each,
#: evenly spaced over its text; every passage of every text is scored.
SAMPLE_DOCS, SAMPLE_PASSAGES = 3000, 512
HIDDEN, GATES, STEPS, BAG_BATCH, RATE = 24, 12, 400, 256, 0.01
THRESHOLD = 0.3
WIDTH = BUCKETS + CLASSES + 5


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (one, of no words, for a blank text)."""
    w = words_of(texts)
    n_pass = np.maximum(1, -(-w.n // PASSAGE))
    base = np.cumsum(n_pass) - n_pass
    nth = np.arange(len(w.hash)) - np.repeat(np.cumsum(w.n) - w.n, w.n)
    of = base[w.text] + nth // PASSAGE
    p = int(n_pass.sum())
    size = np.bincount(of, minlength=p)
    per = 1.0 / np.maximum(1, size)
    out = np.zeros((p, WIDTH), dtype=np.float32)
    bag = np.bincount(of * BUCKETS + (w.hash >> np.uint64(57)).astype(np.int64), minlength=p * BUCKETS).reshape(p, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(bag * per[:, None])
    kinds = np.zeros((p, CLASSES), dtype=np.int64)
    if len(of):  # a passage's bytes are contiguous
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for k in range(1, CLASSES):
            kinds[of[first], k] = np.add.reduceat((w.bytes_class == k).view(np.uint8), w.bytes_start[first], dtype=np.int64)
    length = kinds.sum(axis=1)
    out[:, BUCKETS : BUCKETS + CLASSES] = kinds / np.maximum(1, length)[:, None]
    fine = np.bincount(of * FINE + (w.hash >> np.uint64(48)).astype(np.int64) % FINE, minlength=p * FINE).reshape(p, FINE)
    again = np.zeros((2, p))
    for k in (1, 2):
        same = (w.hash[k:] == w.hash[:-k]) & (of[k:] == of[:-k])
        again[k - 1] = np.bincount(of[k:][same], minlength=p)
    out[:, BUCKETS + CLASSES :] = np.stack([(fine.astype(np.float64) ** 2).sum(axis=1) * per**2, again[0] * per, again[1] * per, length * per / 10, np.log1p(size) / 5], axis=1)
    return out, n_pass


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class AttentionMIL:
    """Encoder tanh(xE + e), gated attention a ~ exp((tanh(hV) * sigmoid(hU)) w), score sigmoid(c . sum(a h) + b)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = {"E": rng.standard_normal((d, HIDDEN)) / np.sqrt(d), "e": np.zeros(HIDDEN), "V": rng.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN), "U": rng.standard_normal((HIDDEN, GATES)) / np.sqrt(HIDDEN), "w": rng.standard_normal(GATES) / np.sqrt(GATES), "c": np.zeros(HIDDEN), "b": np.array([np.log(prior / (1 - prior))])}

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, starts = self.p, np.cumsum(n) - n
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), n))
        a /= np.repeat(_sums(a, starts), n)
        z = _sums(a[:, None] * h, starts)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30))), (x, h, t, g, a, z, starts)

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, (x, h, t, g, a, z, starts) = self.forward(x, n)
        d = (out - y) / len(y)
        dz = d[:, None] * p["c"]
        dzp = np.repeat(dz, n, axis=0)
        da = (dzp * h).sum(axis=1)
        ds = a * (da - np.repeat(_sums(a * da, starts), n))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t**2), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (dzp * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 6) -> AttentionMIL:
        rng, starts = np.random.default_rng(seed), np.cumsum(n) - n
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = rng.permutation(len(n))[:BAG_BATCH]
            rows = np.concatenate([np.arange(starts[i], starts[i] + n[i]) for i in some])
            for k, g in self.gradients(x[rows], n[some], y[some]).items():
                g = g + 1e-4 * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS) -> AttentionMIL | None:
    """The model of the rows of docs whose id has a label 0 or 1; None if no row has. A repeated id counts as often."""
    bounded_batches(docs.sparkSession)
    named = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("quality")), F.lit(1 << 40)).alias("__h"))
    total = named.count()
    if not total:
        return None
    chosen = named.where(F.col("__h") <= int(min(1.0, sample / total) * (1 << 40)))  # about `sample` ids
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col(text_col).cast("string").alias("text"), "__y", "__h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags: list[bytes] = []
            for some in slices(text_bytes(b.column(0))):
                x, n = passages(some)
                for c in np.split(x, np.cumsum(n)[:-1])[: len(some)]:
                    at = np.unique(np.linspace(0, len(c) - 1, min(len(c), SAMPLE_PASSAGES)).astype(np.int64))
                    bags.append(c[at].tobytes())
            yield as_batch({"y": b.column(1), "h": b.column(2), "x": pa.array(bags, pa.binary())})

    got = sorted(((r["h"], bytes(r["x"]), r["y"]) for r in rows.mapInArrow(work, "y int, h long, x binary").toLocalIterator()))[:sample]
    if not got:
        return None
    bags = [np.frombuffer(x, dtype=np.float32).reshape(-1, WIDTH) for _, x, _ in got]
    x, n, y = np.concatenate(bags), np.array([len(b) for b in bags]), np.array([q for _, _, q in got], dtype=np.float64)
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    return AttentionMIL(x.mean(axis=0), x.std(axis=0) + 1e-3, prior).fit(x, n, y)


def score_quality(docs: DataFrame, model: AttentionMIL | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of docs; a null or blank text is one passage of no words. Without a model 0.5."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.full(b.num_rows, 0.5)
            if shared.value is not None and b.num_rows:
                score = np.concatenate([shared.value.forward(*passages(some))[0] for some in slices(text_bytes(b.column(1)))])
            yield as_batch({"doc_id": b.column(0), "score": score})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.select("doc_id", "text"), labels.where(crc_bucket(F.col("doc_id"), 5) != 0).select("doc_id", "quality"))
    found = score_quality(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
