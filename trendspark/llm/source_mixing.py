"""Mixing documents to target shares of domains, with soft membership.

The domains are the classes of a labelled table. A classifier fitted on a bounded sample of it gives each document a
posterior over domains, and rates of documents are fitted so that the expected tokens of each domain, the sum over
documents of rate x tokens x posterior, match the targets: nonnegative least squares by accelerated projected gradient.
Each step of it is one distributed sum of as many numbers as there are domains; rates are never gathered, for a
document's rate follows from its posterior and the residuals of the steps so far, which every task replays.

Targets that no rates in 0..most reach leave a residual: the fit returns the nearest rates it found, and the largest
relative miss of a domain with them; `strict` makes that an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspark.llm.common import as_batch, bounded_batches, free_names, slices, text_bytes
from trendspark.llm.textstats import CLASSES, words_of
from trendspark.session import materialize

BUCKETS = 4096
WIDTH = BUCKETS + CLASSES * CLASSES
#: The classifier is fitted on about so many labelled rows; every domain with labelled text is learned, from at least
#: LEAST_DOCS of its rows where it has them, so the model has WIDTH numbers for each domain.
SAMPLE_DOCS, LEAST_DOCS = 4000, 40
FIT_STEPS, FIT_BATCH, DECAY = 250, 512, 1e-4
#: Shares of tokens by quality and toxicity: of the query, and of the pipeline's mixing, which draws each document once at most.
TARGETS = {"quality1_toxic0": 0.70, "quality0_toxic0": 0.20, "quality1_toxic1": 0.07, "quality0_toxic1": 0.03}
DRAW_TARGETS = {"quality1_toxic0": 0.892, "quality0_toxic0": 0.07, "quality1_toxic1": 0.032, "quality0_toxic1": 0.006}
#: All tokens of the mixture as a share of those of the input, and the highest rate: of the query, and of the pipeline.
KEEP, MAX_RATE = 1.0, 8.0
DRAW_KEEP, DRAW_RATE = 0.85, 1.0
#: Steps at most, the miss, as a share of each domain's own target, at which the fit ends, and the steps without a better
#: one (by a hundredth) after which it gives up: so unreachable targets cost little more than others.
STEPS, CLOSE, PATIENCE = 100, 5e-3, 8


def events(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed words and of word shapes (classes of first and last byte) of each text, and its words."""
    w = words_of(texts)
    word, shape = (w.hash >> np.uint64(52)).astype(np.int64), BUCKETS + w.first.astype(np.int64) * CLASSES + w.last
    out = np.bincount(w.text * WIDTH + word, minlength=len(texts) * WIDTH)
    out += np.bincount(w.text * WIDTH + shape, minlength=len(texts) * WIDTH)
    return out.reshape(-1, WIDTH).astype(np.float32), w.n


def features(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which events occur, and the logs of the counts of shapes."""
    return (counts > 0).astype(np.float32), np.log1p(counts[:, BUCKETS:])


def posteriors(some: tuple[np.ndarray, np.ndarray], model: dict) -> np.ndarray:
    z = (some[0] @ model["weights"].T + some[1] @ model["shapes"].T + model["bias"]).astype(np.float64)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def memberships(texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Words and posteriors of the texts, a slice of them at a time."""
    sizes, found = [], []
    for some in slices(texts):
        counts, n = events(some)
        sizes.append(n)
        found.append(posteriors(features(counts), model) if model["names"] else np.zeros((len(some), 0)))
    return np.concatenate(sizes).astype(np.int64), np.concatenate(found)


def fit_domains(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    sample: int = SAMPLE_DOCS,
    least: int = LEAST_DOCS,
) -> dict:
    """Softmax regression on which words occur and how often which shapes do, of all domains that have labelled text.

    Rows are drawn by a hash of the id, at a rate for each domain that expects its part of `sample` and `least` at least;
    the bias is set back to the natural shares. No labelled text: no names.
    """
    bounded_batches(docs.sparkSession)
    span = 1 << 40
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("domain")), F.lit(span))
    known = labels.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull())
    named = known.select(F.col(id_col).alias("__id"), F.col(domain_col).cast("string").alias("__d"), hashed.alias("__h"))
    sizes = {r["__d"]: r["count"] for r in named.groupBy("__d").count().collect()}  # a row for each domain
    total = sum(sizes.values())
    goal = {d: min(n, max(least, sample * n / total)) for d, n in sizes.items()}
    limits = docs.sparkSession.createDataFrame([(d, int(goal[d] / n * span)) for d, n in sizes.items()], "__d string, __most long")
    chosen = named.join(F.broadcast(limits), "__d").where("__h <= __most").drop("__most")  # about `sample` ids, `least` of each domain
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(F.col(text_col).cast("string").alias("text"), "__d", "__h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [x.tobytes() for some in slices(text_bytes(b.column(0))) for x in events(some)[0][: len(some)]]
            yield as_batch({"d": b.column(1), "h": b.column(2), "c": pa.array(counts, pa.binary())})

    got: dict[str, list] = {}
    for r in rows.mapInArrow(work, "d string, h long, c binary").toLocalIterator():
        got.setdefault(r["d"], []).append((r["h"], bytes(r["c"])))
    names = sorted(got)
    if not names:
        return {"names": [], "weights": np.zeros((0, WIDTH)), "shapes": np.zeros((0, WIDTH - BUCKETS)), "bias": np.zeros(0)}
    kept = {d: sorted(got.pop(d))[: int(np.ceil(goal[d] * 1.2)) + 1] for d in names}  # an id may stand on many rows
    x = np.stack([np.frombuffer(c, dtype=np.float32) for d in names for _, c in kept[d]])
    y = np.repeat(np.arange(len(names)), [len(kept[d]) for d in names])
    share = (np.bincount(y, minlength=len(names)) + 0.5) / (len(y) + 0.5 * len(names))
    model = {
        "names": names,
        "weights": np.zeros((len(names), WIDTH), np.float32),
        "shapes": np.zeros((len(names), WIDTH - BUCKETS), np.float32),
        "bias": np.log(share).astype(np.float32),
    }
    present, shapes = features(x)
    del x
    rng = np.random.default_rng(8)
    first, second = ({k: np.zeros_like(model[k]) for k in ("weights", "shapes", "bias")} for _ in range(2))
    for step in range(1, FIT_STEPS + 1):
        some = rng.permutation(len(y))[:FIT_BATCH]
        now = present[some], shapes[some]
        d = posteriors(now, model).astype(np.float32)
        d[np.arange(len(some)), y[some]] -= 1
        d /= len(some)
        steps = {"weights": d.T @ now[0], "shapes": d.T @ now[1], "bias": d.sum(axis=0)}
        for k, g in steps.items():  # Adam
            g = g + DECAY * model[k] * (k != "bias")
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            rate = 0.02 * (1 - step / (FIT_STEPS + 1))
            model[k] = model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    natural = np.array([sizes[d] for d in names], dtype=np.float64) / total
    model["bias"] = (model["bias"] + np.log(natural / (np.bincount(y, minlength=len(names)) / len(y)))).astype(np.float32)
    return model


def rates(p: np.ndarray, residuals: list[np.ndarray], step: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates, and the extrapolated ones whose residual comes next, after the steps with these residuals."""
    r = y = np.ones(len(p))
    t = 1.0
    for g in residuals:
        new = np.clip(y - step * (p @ g), 0.0, most)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - r)
        r, t = new, t2
    return r, y


def _fields(docs: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in added)])


def _with_memberships(docs: DataFrame, model: dict, text_col: str, n_col: str, p_col: str) -> DataFrame:
    """docs with the columns n_col (tokens) and p_col (posterior), written out."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers for each domain
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = memberships(text_bytes(b.column(at)), shared.value)
            posterior = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), posterior], names=[*b.schema.names, n_col, p_col])

    schema = _fields(docs, (n_col, T.LongType()), (p_col, T.ArrayType(T.DoubleType())))
    return materialize(docs.mapInArrow(work, schema), "mixing")


def fit_rates(soft: DataFrame, names: list[str], targets: dict[str, float], keep: float, most: float, steps: int = STEPS, n_col: str = "n_tokens", p_col: str = "posterior") -> dict:
    """total, want and reached (shares of the total by domain), residual (largest relative miss) and residuals (of the steps)."""
    total = soft.agg(F.sum(n_col)).first()[0] or 0
    want = np.array([max(0.0, targets.get(k, 0.0)) for k in names])
    if not total or not want.sum():
        return {"total": total, "want": {}, "reached": {}, "residual": 0.0, "residuals": []}
    want = want / want.sum() * keep
    residuals: list[np.ndarray] = []

    def sums(residuals: list[np.ndarray], ahead: bool) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(names))
            for b in batches:
                p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names))
                out += (rates(p, residuals, 1.0, most)[ahead] * b.column(0).to_numpy()) @ p
            yield as_batch({"k": np.arange(len(names)), "t": out})

        got = soft.select(n_col, p_col).mapInArrow(work, "k long, t double").groupBy("k").agg(F.sum("t").alias("t")).collect()
        out = np.zeros(len(names))
        for r in got:
            out[r["k"]] = r["t"] / total
        return out

    # Domains are weighed by 1 / their natural share and rates by 1 / tokens: then the step 1 is safe, as posteriors sum to one.
    natural = np.maximum(sums([], False), 1e-12)
    scale = np.where(want > 0, want, natural)
    best, since = np.inf, 0
    for _ in range(steps):
        off = sums(residuals, True) - want
        miss = float((np.abs(off) / scale).max())
        best, since = (miss, 0) if miss < 0.99 * best else (best, since + 1)
        if miss <= CLOSE or since >= PATIENCE:
            break
        residuals.append(off / natural)
    reached = sums(residuals, False)
    return {
        "total": total,
        "want": dict(zip(names, want.tolist(), strict=True)),
        "reached": dict(zip(names, reached.tolist(), strict=True)),
        "residual": float((np.abs(reached - want) / scale).max()),
        "residuals": residuals,
    }


def _with_rates(soft: DataFrame, residuals: list[np.ndarray], width: int, most: float, p_col: str, rate_col: str) -> DataFrame:
    at = soft.columns.index(p_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates(p, residuals, 1.0, most)[0])], names=[*b.schema.names, rate_col])

    if not residuals:
        return soft.withColumn(rate_col, F.lit(1.0))
    return soft.mapInArrow(work, _fields(soft, (rate_col, T.DoubleType())))


def _checked(info: dict, strict: bool) -> None:
    if strict and info["residual"] > 2 * CLOSE:
        raise ValueError(f"no rates found for these targets: a domain misses its own by {info['residual']:.3f} of it")


def mix(
    docs: DataFrame,
    model: dict,
    targets: dict[str, float],
    keep: float = KEEP,
    most: float = MAX_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    steps: int = STEPS,
    strict: bool = False,
) -> tuple[DataFrame, dict]:
    """(doc_id, key, n_tokens, posterior, rate) of each row of docs, and what fit_rates found.

    key: hash of the text. Targets are shares of keep x all tokens; a domain without a target gets none, targets of unknown
    domains are left out and the rest scaled up. Rates lie in 0..most. Nothing learned, no targets or no tokens: rate 1 for
    all rows. A null text has no tokens and the posterior of an empty one. Repeated rows get rates of their own, all equal.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    soft = _with_memberships(rows, model, "text", "n_tokens", "posterior").drop("text")
    info = fit_rates(soft, model["names"], targets, keep, most, steps)
    _checked(info, strict)
    return _with_rates(soft, info["residuals"], len(model["names"]), most, "posterior", "rate"), info


def copies(rate: Column, doc_id: Column, key: Column) -> Column:
    """Copies of a document: the rate's whole part, and one more with the probability of the rest, by a hash of id and text."""
    drawn = F.pmod(F.xxhash64(doc_id, key, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def draw(
    docs: DataFrame,
    model: dict,
    targets: dict[str, float],
    keep: float = DRAW_KEEP,
    most: float = DRAW_RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    strict: bool = False,
) -> DataFrame:
    """The mixture: docs with each row as often as its rate draws it (at most once at rates up to 1); columns as they are.

    The rows are written once with their posteriors; the fit reads only these, and the drawing reads the rows back, so no
    text is shuffled and its features are taken once. Rows that repeat both id and text are drawn alike. Extra columns of
    any name pass through.
    """
    n_col, p_col, rate_col, many, each = free_names(docs, "n", "posterior", "rate", "copies", "copy")
    soft = _with_memberships(docs, model, text_col, n_col, p_col)
    info = fit_rates(soft, model["names"], targets, keep, most, STEPS, n_col, p_col)
    _checked(info, strict)
    rated = _with_rates(soft, info["residuals"], len(model["names"]), most, p_col, rate_col)
    n = copies(F.col(rate_col), F.col(id_col), F.xxhash64(F.col(text_col).cast("string")))
    drawn = rated.withColumn(many, n).where(F.col(many) > 0)
    if most > 1:
        drawn = drawn.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(many).cast("int"))))
    return drawn.select(*docs.columns)


def label_domains(labels: DataFrame) -> DataFrame:
    named = F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))
    return labels.select("doc_id", named.alias("domain"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; `residual`, the same on all, is the largest miss of a domain as a share of its target."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_domains(docs, label_domains(labels))
    found, info = mix(docs, model, TARGETS)
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{k}") for i, k in enumerate(model["names"])]
    drawn = copies(F.col("rate"), F.col("doc_id"), F.col("key")).alias("copies")
    return found.select("doc_id", "n_tokens", *shares, "rate", drawn, F.lit(info["residual"]).alias("residual"))
