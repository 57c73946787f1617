"""Language-model scores by weighted backoff, with tables of n-grams that grow with the corpus.

Tokens are counted over all training texts, and so are their n-grams up to ORDER, whatever words they hold; every n-gram
that occurs LEAST times is kept. Estimates are by absolute discounting: what is taken from seen n-grams is spread over the
rest by the shorter context; for single tokens it is the probability of the unseen token. The weights of the shorter
contexts make each context's probabilities sum to one.

The log-probability of a word after its context is a sum over the n-grams that end at it: the word's own, for each context
the weight of backing off from it, and for each kept n-gram what it has above backing off. So a text's score is the sum of
one value for each n-gram in it, and values come by one join: no table of all words or n-grams is in one place. A token
with at least CORE of all tokens (at most 1 / CORE) and an n-gram with at least COMMON of them has its value broadcast too,
the same value, so that no hot key is shuffled. n-grams are named by 64-bit hashes; the counts of tokens go by the tokens themselves.

The n-grams of each order are counted, and asked for, in ROUNDS by their names, and what a round shuffled is removed before
the next one begins, so that the disk holds a share of the places at a time; each round reads all texts. A task packs its
n-grams by bucket of names, some BUCKET places in each, which meet in a task that adds up their counts or looks up their values.

A caller who wants a bounded model gives `common`: n-grams of core words with that share of all tokens become an automaton
with a state for each context that some n-gram continues, an arc for each n-gram, which carries its log-probability and
the next state, and a failure arc from each context to the next shorter one, which carries the backoff weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import as_batch, bounded_batches, crc_bucket, text_bytes
from trendspark.session import drop, materialize, short_shuffles

CORE, COMMON, ORDER = 2e-6, 1e-5, 3
DISCOUNT, LEAST = 0.75, 2
#: No word is a line end, so it can stand for the end of a text.
END = b"\n"
HELD_TYPES, HELD_CODES, HELD_GRAMS, BLOCK = 400_000, 4 << 20, 2 << 20, 256
#: Rounds of an order beyond 2; places in a bucket; buckets of a round at least; rows that two bytes number.
ROUNDS, BUCKET, BUCKETS, MOST_ROWS = 2, 1 << 18, 64, 1 << 16


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, gram, c) with the tokens' names over a one-column frame of texts; each task adds up, and passes on what it holds beyond HELD_TYPES types."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            codes, _, words = coded(b.column(0))
            held.update(dict(zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True)))
            if len(held) > HELD_TYPES:
                yield as_batch({"token": pa.array(list(held), pa.binary()), "gram": name_words(list(held)), "c": pa.array(list(held.values()), pa.int64())})
                held = Counter()
        yield as_batch({"token": pa.array(list(held), pa.binary()), "gram": name_words(list(held)), "c": pa.array(list(held.values()), pa.int64())})

    return texts.mapInArrow(work, "token binary, gram long, c long").where("c > 0").groupBy("token", "gram").agg(F.sum("c").alias("c"))


def word_ids(texts: list[bytes], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Core numbers of all tokens one after the other, -1 for others; tokens of each text; the tokens."""
    words = [tokens(t) for t in texts]
    get = number.get
    flat = np.fromiter((get(w, -1) for ws in words for w in ws), dtype=np.int64, count=sum(map(len, words)))
    return flat, np.array([len(w) for w in words], dtype=np.int64), words


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all tokens one after the other, the number of tokens of each text, and the distinct tokens by code."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat = words.flatten()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    told, of = flat.filter(pa.array(full)).dictionary_encode(), of[full]
    sizes = np.bincount(of, minlength=len(texts)) + 1
    codes = np.full(int(sizes.sum()), len(told.dictionary), dtype=np.int64)
    codes[np.arange(len(of)) + of] = told.indices.to_numpy(zero_copy_only=False)
    return codes, sizes, [*told.dictionary.cast(pa.binary()).to_pylist(), END]


#: Odd factors of names, and their inverses modulo 2 ** 64.
HEAD, TAIL, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9
OF_TAIL, OF_MIX = pow(TAIL, -1, 1 << 64), pow(MIX, -1, 1 << 64)


def pair(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Names of the n-grams whose first words are named `head` and whose last words `tail`, each without one word."""
    x = head.view(np.uint64) * np.uint64(HEAD) + tail.view(np.uint64) * np.uint64(TAIL)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def tail_of(gram: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The tails of which `pair` made these names with these heads."""
    x = gram.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(OF_MIX)
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    return ((x - head.view(np.uint64) * np.uint64(HEAD)) * np.uint64(OF_TAIL)).view(np.int64)


def stirred(x: np.ndarray) -> np.ndarray:
    """A number that looks random for each 64-bit number, another one for another."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that end a word; a random factor for each byte, capitals as small letters.
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8))
BYTE = stirred(np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8).astype(np.uint64) * np.uint64(HEAD) + np.uint64(TAIL))


def names_of(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Names of the words whose bytes begin at `first`: sums of products of a factor for each byte and one for its place."""
    out = np.zeros(len(first), dtype=np.uint64)
    cuts = np.append(first, len(text))
    factor = stirred(np.arange(1, int(np.diff(cuts).max(initial=0)) + 1, dtype=np.uint64) * np.uint64(HEAD))
    for i in range(0, len(first), BLOCK * 16):  # a part that stays in a core's cache
        part = cuts[i : i + BLOCK * 16 + 1]
        begin = part[:-1] - part[0]
        place = np.arange(part[-1] - part[0]) - np.repeat(begin, np.diff(part))
        out[i : i + BLOCK * 16] = np.add.reduceat(BYTE[text[part[0] : part[-1]]] * factor[place], begin)
    return stirred(out).view(np.int64)


def name_words(words: list[bytes]) -> np.ndarray:
    """Names of words, none of them empty."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    return names_of(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(size) - size)


def named(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens one after the other, and the number of tokens of each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    cuts = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[cuts[0] : cuts[-1]]
    cuts = (cuts - cuts[0]).astype(np.int64)
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = cuts[:-1][cuts[:-1] < len(data)]
    begins[inner] = word[inner]
    at = np.flatnonzero(begins)
    names = names_of(data[word], np.flatnonzero(begins[word]))
    n = np.diff(np.searchsorted(at, cuts))
    of, sizes = np.repeat(np.arange(len(texts)), n), n + 1
    out = np.full(int(sizes.sum()), name_words([END])[0])
    out[np.arange(len(of)) + of] = names
    return out, sizes


def grams_of(h: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 2: which positions end an n-gram, their names, and those of them without the last word."""
    nth = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    now = h
    for n in range(2, order + 1):
        before = np.append(now[:1], now[:-1])
        now = pair(before, now)
        yield nth >= n - 1, now, before


def rounds(order: int) -> int:
    """Fewer pairs than longer n-grams are distinct."""
    return 1 if order == 2 else ROUNDS


def bucket_bits(places: int) -> int:
    """First bits of a name that are its bucket; a round has the buckets that leave its number when divided by the rounds."""
    return max(places // BUCKET, ROUNDS * BUCKETS).bit_length()


def bucket_of(gram: np.ndarray, bits: int) -> np.ndarray:
    return (gram.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def packs(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The buckets, which come in order, and for each of the columns its bytes in each bucket."""
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    return bucket[cuts[:-1]], [packed(x, cuts) for x in columns]


def packed(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of x[cuts[i]:cuts[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((x.itemsize * cuts).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def gram_round(texts: pa.Array, order: int, bits: int, nth_round: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places of n-grams of an order whose buckets are in this round: the texts, the names, and those without the last word."""
    h, sizes = named(texts)
    *_, (ends, gram, head) = grams_of(h, sizes, order)
    if rounds(order) > 1:
        ends &= bucket_of(gram, bits) % rounds(order) == nth_round
    return np.repeat(np.arange(len(sizes)), sizes)[ends], gram[ends], head[ends]


def ordered(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the names, as unsigned numbers, and where in it another name begins."""
    by = np.argsort(gram.view(np.uint64))
    x = gram[by]
    return by, np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def count_all_grams(texts: DataFrame, order: int, bits: int, nth_round: int) -> DataFrame:
    """(gram, head, tail, c): the n-grams of an order and a round that occur LEAST times, those one shorter, and counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def add_up() -> pa.RecordBatch:
            gram, head = (np.concatenate(x) for x in zip(*held, strict=True))
            by, first = ordered(gram)
            gram, head, c = gram[by[first]], head[by[first]], np.diff(np.append(first, len(by))).astype(np.int32)
            buckets, columns = packs(bucket_of(gram, bits), gram, head, c)
            return as_batch(dict(zip(("bucket", "gram", "head", "c"), (buckets, *columns), strict=True)))

        for b in batches:
            _, gram, head = gram_round(b.column(0), order, bits, nth_round)
            held.append((gram, head))
            size += len(gram)
            if size > HELD_GRAMS:
                yield add_up()
                held, size = [], 0
        if size:
            yield add_up()

    def total(t: pa.Table) -> pa.Table:
        gram, head, c = (np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in t[k]]) for k, kind in (("gram", np.int64), ("head", np.int64), ("c", np.int32)))
        by, first = ordered(gram)
        c = np.add.reduceat(c[by].astype(np.int64), first)
        kept = by[first[c >= LEAST]]
        return pa.table({"gram": gram[kept], "head": head[kept], "tail": tail_of(gram[kept], head[kept]), "c": c[c >= LEAST]})

    found = texts.mapInArrow(work, "bucket long, gram binary, head binary, c binary").groupBy("bucket")
    return found.applyInArrow(total, "gram long, head long, tail long, c long")


def gram_values(texts: DataFrame, counts: DataFrame, total: int, d1: float, order: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(token, c, value) of all tokens and (gram, c, value, n) of all n-grams of n words; values as the module says, a token's without its own.

    Each table is removed, `counts` too, when it isn't needed any more.
    """
    # A context's words have counts of at least LEAST; two tokens of one hash would count as one context.
    lower = materialize(counts.where(F.col("c") >= LEAST).groupBy("gram").agg(F.sum("c").alias("c"), F.sum((F.col("c") - d1) / max(1, total)).alias("p")).withColumn("above", F.lit(0.0)), "lm-lower")
    levels = []
    for n in range(2, order + 1):
        grams = reduce(DataFrame.union, [materialize(count_all_grams(texts, n, bits, k), "lm-grams") for k in range(rounds(n))])
        own = grams.select("gram", "head", "tail", "c").join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("low")), "tail")
        own = materialize(own.select("gram", "head", "c", "low"), "lm-own")
        drop(grams)
        left = own.groupBy("head").agg(F.sum(F.col("c") - DISCOUNT).alias("taken"), F.sum("low").alias("low_taken"))
        left = left.join(lower.select(F.col("gram").alias("head"), F.col("c").alias("of")), "head")
        back = F.log10(F.greatest(1 - F.col("taken") / F.col("of"), F.lit(1e-12)) / F.greatest(1 - F.col("low_taken"), F.lit(1e-12)))
        left = materialize(left.select("head", "of", back.alias("back")), "lm-contexts")
        levels.append(materialize(lower.join(left.select(F.col("head").alias("gram"), "back"), "gram", "left").select("gram", "c", (F.col("above") + F.coalesce("back", F.lit(0.0))).alias("value"), F.lit(n - 1).alias("n")), "lm-level"))
        drop(lower)
        p = (F.col("c") - DISCOUNT) / F.col("of")
        lower = materialize(own.join(left, "head").select("gram", "c", p.alias("p"), (F.log10(p) - F.col("back") - F.log10("low")).alias("above")), "lm-lower")
        drop(own)
        drop(left)
    first, *rest = [*levels, lower.select("gram", "c", F.col("above").alias("value"), F.lit(order).alias("n"))]
    valued = counts.join(first.select("gram", "value"), "gram", "left").select("token", "c", F.coalesce("value", F.lit(0.0)).alias("value"))
    valued = materialize(valued, "lm-values")
    drop(counts)
    drop(first)
    return valued, reduce(DataFrame.union, rest)


def grams_at(ids: np.ndarray, sizes: np.ndarray, kept: list[np.ndarray], base: int) -> np.ndarray:
    """For each position the number of the kept n-gram of the highest order in `kept` that ends there, or -1.

    kept[k]: sorted codes of the n-grams of order k + 2; a code is the number of its prefix times base plus its last word.
    """
    first = np.zeros(len(ids), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    now = np.where(ids < base, ids, -1)
    for codes in kept:
        code = candidates(now, ids, first, base)
        at = np.searchsorted(codes, code)
        now = np.where((code >= 0) & (at < len(codes)) & (codes[np.minimum(at, max(0, len(codes) - 1))] == code if len(codes) else False), at, -1)
    return now


def candidates(now: np.ndarray, ids: np.ndarray, first: np.ndarray, base: int) -> np.ndarray:
    """Codes of the n-grams one longer than those in `now`, -1 where prefix or suffix isn't kept."""
    code = np.full(len(ids), -1, dtype=np.int64)
    ok = (now[:-1] >= 0) & (now[1:] >= 0) & ~first[1:]
    code[1:][ok] = now[:-1][ok] * base + ids[1:][ok]
    return code


def count_grams(texts: DataFrame, number: dict[bytes, int], kept: list[np.ndarray], base: int, least: float) -> dict[int, int]:
    """Codes and counts of the n-grams one order above `kept`, of those that occur `least` times; at most N / least of them."""
    shared = texts.sparkSession.sparkContext.broadcast((number, kept))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept = shared.value
        held: list[np.ndarray] = []

        def add_up() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *held]), return_counts=True)
            return as_batch({"code": codes, "c": n.astype(np.int64)})

        for b in batches:
            ids, sizes, _ = word_ids(text_bytes(b.column(0)), number)
            first = np.zeros(len(ids), dtype=bool)
            first[np.cumsum(sizes) - sizes] = True
            code = candidates(grams_at(ids, sizes, kept, base), ids, first, base)
            held.append(code[code >= 0])
            if sum(map(len, held)) > HELD_CODES:
                yield add_up()
                held = []
        yield add_up()

    found = texts.mapInArrow(work, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    return {r["code"]: r["c"] for r in found.collect()}


class Backoff:
    """The automaton. State 0 is the root; arcs[k] = state * width + word; log10 weights."""

    def __init__(self, counts: np.ndarray, total: int, types: int, d1: float, base: int, grams: list[dict[int, int]]) -> None:
        self.width = max(1, len(counts))
        self.root = np.log10(np.maximum(counts - d1, 1e-300) / max(1, total))
        self.unseen = float(np.log10(d1 * types / total)) if total and types else 0.0
        self.fail, self.weight = np.zeros(1, dtype=np.int64), np.zeros(1)
        prob: list[dict[tuple[int, ...], float]] = [{(w,): float((counts[w] - d1) / total) for w in range(len(counts))} if total else {}]
        seen: list[dict[tuple[int, ...], int]] = [{(w,): int(c) for w, c in enumerate(counts.tolist())}]
        order: list[list[tuple[int, ...]]] = [[(w,) for w in range(base)]]
        for found in grams:
            codes = sorted(found)
            names = [(*order[-1][c // base], c % base) for c in codes]
            order.append(names)
            seen.append({g: found[c] for g, c in zip(names, codes, strict=True)})
            prob.append({g: (n - DISCOUNT) / seen[-2][g[:-1]] for g, n in seen[-1].items()})
        context: dict[tuple[int, ...], int] = {}
        for k in range(1, len(prob)):
            for g in prob[k]:
                context.setdefault(g[:-1], len(context) + 1)
        left = np.ones((len(context) + 1, 2))
        for k in range(1, len(prob)):
            for g, p in prob[k].items():
                left[context[g[:-1]]] -= (p, prob[k - 1][g[1:]])  # each suffix of a kept n-gram is kept
        self.left = left
        self.fail, self.weight = np.zeros(len(left), dtype=np.int64), np.zeros(len(left))
        for h, s in context.items():
            self.fail[s] = self._state(context, h[1:])
            self.weight[s] = np.log10(max(left[s][0], 1e-12) / max(left[s][1], 1e-12))
        arcs = sorted((context[g[:-1]] * self.width + g[-1], float(np.log10(p)), self._state(context, g)) for k in range(1, len(prob)) for g, p in prob[k].items())
        self.arcs = np.array([a[0] for a in arcs], dtype=np.int64)
        self.log = np.array([a[1] for a in arcs])
        self.to = np.array([a[2] for a in arcs], dtype=np.int64)
        self.after = np.array([context.get((w,), 0) for w in range(len(counts))], dtype=np.int64)

    @staticmethod
    def _state(context: dict, h: tuple[int, ...]) -> int:
        while h and h not in context:
            h = h[1:]
        return context.get(h, 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the words (of others only the failure arcs' weights) and the next states."""
        out, at, nxt = np.zeros(len(state)), state.copy(), np.zeros(len(state), dtype=np.int64)
        todo = np.arange(len(state))
        while len(todo):
            s, w = at[todo], word[todo]
            if len(self.arcs):
                key = np.where((s > 0) & (w >= 0), s * self.width + w, -1)
                k = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = self.arcs[k] == key
                out[todo[hit]] += self.log[k[hit]]
                nxt[todo[hit]] = self.to[k[hit]]
            else:
                hit = np.zeros(len(todo), dtype=bool)
            root = ~hit & (s == 0)
            known = root & (w >= 0)
            out[todo[known]] += self.root[w[known]]
            nxt[todo[known]] = self.after[w[known]]
            rest = ~hit & ~root
            out[todo[rest]] += self.weight[s[rest]]
            at[todo[rest]] = self.fail[s[rest]]
            todo = todo[rest]
        return out, nxt

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum over each text. Texts are read in blocks side by side; a block reads the ORDER words before it for its state."""
        n = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        begin = (np.cumsum(sizes) - sizes)[of]
        start, size = begin + nth * BLOCK, np.minimum(BLOCK, sizes[of] - nth * BLOCK)
        state, total = np.zeros(len(of), dtype=np.int64), np.zeros(len(of))
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")
        for j in range(-ORDER, BLOCK):
            live = order if j < 0 else order[: active[j]]
            if j < 0:
                live = live[nth[live] > 0]
            if not len(live):
                continue
            got, state[live] = self.step(state[live], ids[start[live] + j])
            if j >= 0:
                total[live] += got
        return np.bincount(of, total, minlength=len(sizes))


def fit(texts: DataFrame, core: float = CORE, common: float | None = None, order: int = ORDER) -> tuple[DataFrame, dict]:
    """The counts of all tokens (token, c, value), written out, and the model.

    Without `common` the model holds all n-grams as a table; with it those of core words with that share, as an automaton.
    """
    texts = texts.select(F.col(texts.columns[0]).cast("string").alias("text"))
    with short_shuffles(texts.sparkSession):
        counts = materialize(count_tokens(texts), "lm-counts")
    total, types, n1, n2 = (x or 0 for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    d1 = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
    rows = counts.where(F.col("c") >= core * total).collect()  # at most 1 / core
    words = sorted(((bytes(r["token"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))
    number = {w: i for i, (w, _) in enumerate(words)}
    c = np.array([n for _, n in words], dtype=np.float64)
    unseen = float(np.log10(d1 * types / total)) if total and types else 0.0
    model = {"core": core * total, "number": number, "c": c, "total": total, "types": types, "d1": d1, "unseen": unseen, "order": order}
    if common is None:
        bits = bucket_bits(total)
        with short_shuffles(counts.sparkSession):
            counts, table = gram_values(texts, counts, total, d1, order, bits)
        value = {bytes(r["token"]): r["value"] for r in counts.where(F.col("c") >= core * total).collect()}
        hot = sorted((r["gram"], r["value"]) for r in table.where(F.col("c") >= max(LEAST, COMMON * total)).collect()) if COMMON * total >= LEAST else []  # at most 1 / COMMON of an order
        local = {"after": np.array([value[w] for w, _ in words]), "hot": np.array([g for g, _ in hot], dtype=np.int64), "hot_value": np.array([v for _, v in hot])}
        return counts, model | {"table": table, "local": local, "bits": bits}
    least = max(2.0, common * total)
    base = max(1, int((c >= least).sum()))
    grams: list[dict[int, int]] = []
    while len(grams) < order - 1 and len(number):
        found = count_grams(texts, number, [np.array(sorted(g), dtype=np.int64) for g in grams], base, least)
        if not found:
            break
        grams.append(found)
    counts = counts.select("token", "c", F.lit(0.0).alias("value"))
    return counts, model | {"automaton": Backoff(c, total, types, d1, base, grams)}


def score_texts(docs: DataFrame, counts: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): one row for each row of docs.

    A null text is empty: the end alone. Rows that repeat id and text come back as often. With nothing learned both scores
    are 0 for each token. Other columns don't matter. Rows are numbered by partition and place, and each round reads them anew,
    so they are written first, unless docs is `stored`: files as they are read, which come in the same order each time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with short_shuffles(spark):
        rows = rows if stored else materialize(rows, "lm-texts")
        sums = [materialize(score_tokens(rows, counts, model), "lm-sums")]
        if "table" in model:
            hot = spark.sparkContext.broadcast(model["local"]["hot"])  # at most 1 / COMMON of an order
            cold = model["table"].where(F.col("c") < max(LEAST, COMMON * model["total"])) if COMMON * model["total"] >= LEAST else model["table"]
            for n in range(2, model["order"] + 1):
                sums += [materialize(score_grams(rows, cold.where(F.col("n") == n), hot, n, model["bits"], k), "lm-sums") for k in range(rounds(n))]
        if not stored:
            drop(rows)
    first, *rest = sums
    for x in rest:
        first = first.unionByName(x, allowMissingColumns=True)
    found = first.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return found.select("doc_id", "n_tokens", "n_known", "base_score", "score")


def score_tokens(docs: DataFrame, counts: DataFrame, model: dict) -> DataFrame:
    """(row, doc_id, n, known, base, score): sums over the tokens of each row, and over the n-grams that all tasks know.

    A batch asks once for each token that not all tasks know, and names the rows it is in.
    """
    shared = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "table"})  # bounded by 1 / CORE words and 1 / COMMON n-grams of an order
    total, types, d1 = model["total"], model["types"], model["d1"]
    log_all = float(np.log10(total + 0.1 * (types + 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number, automaton, local = m["number"], m.get("automaton"), m.get("local")
        base = np.append(np.log10(m["c"] + 0.1) - log_all, 0.0)
        own = np.append(np.log10(np.maximum(m["c"] - d1, 1e-300) / max(1, total)) + local["after"], 0.0) if local else base
        start = TaskContext.get().partitionId() << 40
        for b in batches:
            codes, sizes, words = coded(b.column(1))
            ids = np.fromiter((number.get(w, -1) for w in words), dtype=np.int64, count=len(words))[codes]
            of = np.repeat(np.arange(len(sizes)), sizes)
            core = np.bincount(of, ids >= 0, minlength=len(sizes)).astype(np.int64)
            sums = np.bincount(of, base[ids], minlength=len(sizes))
            if local:
                score = np.bincount(of, own[ids], minlength=len(sizes))
                if len(local["hot"]):
                    for ends, gram, _ in grams_of(named(b.column(1))[0], sizes, m["order"]):
                        k = np.where(ends, known_at(local["hot"], gram), -1)
                        score += np.bincount(of[k >= 0], local["hot_value"][k[k >= 0]], minlength=len(sizes))
            else:
                score = automaton.score(ids, sizes)
            # The rows of the texts themselves: no word begins with a space, so the join finds nothing.
            own_rows = pa.array([b" " + i.to_bytes(8) for i in range(start, start + len(sizes))], pa.binary())
            yield as_batch({"tag": np.full(len(sizes), start), "token": own_rows, "at": packed(np.arange(len(sizes)).astype(np.uint16), np.arange(len(sizes) + 1)), "doc_id": b.column(0), "n": sizes, "known": core, "base": sums, "score": score})
            rest = np.flatnonzero(ids < 0)
            if len(rest):
                by = rest[np.argsort(codes[rest], kind="stable")]
                x = codes[by]
                new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                told = [words[i] for i in x[new].tolist()]
                none, zero = np.zeros(len(told), dtype=np.int64), np.zeros(len(told))
                yield as_batch({"tag": np.full(len(told), start), "token": pa.array(told, pa.binary()), "at": packed(of[by].astype(np.uint16), np.append(new, len(by))), "doc_id": pa.nulls(len(told), pa.int64()), "n": none, "known": none, "base": zero, "score": zero})
            start += len(sizes)

    rows = docs.mapInArrow(work, "tag long, token binary, at binary, doc_id long, n long, known long, base double, score double")
    told = counts.where(F.col("c") < model["core"]).select("token", "c", "value")
    joined = rows.join(told, "token", "left")
    seen, asks = F.col("c").isNotNull(), F.col("n") == 0
    known = F.col("known") + F.when(seen, 1).otherwise(0)
    base = F.col("base") + F.when(asks, F.log10(F.coalesce("c", F.lit(0)) + 0.1) - log_all).otherwise(0.0)
    own = F.when(seen, F.log10((F.col("c") - d1) / max(1, total))).when(asks, model["unseen"]).otherwise(0.0)
    each = joined.select("tag", "at", "doc_id", "n", known.alias("known"), base.alias("base"), (F.col("score") + own + F.coalesce("value", F.lit(0.0))).alias("score"))
    sums = each.mapInArrow(add_places, "row long, doc_id long, n long, known long, base double, score double").groupBy("row")
    return sums.agg(F.max("doc_id").alias("doc_id"), *(F.sum(k).alias(k) for k in ("n", "known", "base", "score")))


def known_at(names: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """For each of gram its place in the sorted names, or -1."""
    if not len(names):
        return np.full(len(gram), -1)
    k = np.minimum(np.searchsorted(names, gram), len(names) - 1)
    return np.where(names[k] == gram, k, -1)


def score_grams(docs: DataFrame, table: DataFrame, hot: Broadcast, order: int, bits: int, nth_round: int) -> DataFrame:
    """(row, score): sums over the n-grams of an order and a round, but for the hot ones, of the rows that hold a kept one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = rows = 0
        start = TaskContext.get().partitionId() << 40

        def ask() -> pa.RecordBatch:
            of, gram = (np.concatenate(x) for x in zip(*held, strict=True))
            by, first = ordered(gram)
            names = gram[by[first]]
            unknown = known_at(hot.value, names) < 0
            often = np.diff(np.append(first, len(by)))
            by, names, often = by[np.repeat(unknown, often)], names[unknown], often[unknown]
            bucket = bucket_of(names, bits)
            buckets, (gram, n) = packs(bucket, names, often.astype(np.int32))
            _, (at,) = packs(np.repeat(bucket, often), of[by].astype(np.uint16))
            return as_batch({"bucket": buckets, "start": np.full(len(buckets), start), "gram": gram, "n": n, "at": at})

        for b in batches:
            if held and (size > HELD_GRAMS or rows + b.num_rows > MOST_ROWS):
                yield ask()
                held, size, rows, start = [], 0, 0, start + rows
            of, gram, _ = gram_round(b.column(1), order, bits, nth_round)
            held.append((of + rows, gram))
            size += len(gram)
            rows += b.num_rows
        if held:
            yield ask()

    def answer(asked: pa.Table, told: pa.Table) -> pa.Table:
        names, values = told["gram"].to_numpy(), told["value"].to_numpy()
        by = np.argsort(names)
        names, values = names[by], values[by]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0))]
        for i in range(asked.num_rows if len(names) else 0):
            gram, n, at = (np.frombuffer(asked[k][i].as_buffer(), dtype=kind) for k, kind in (("gram", np.int64), ("n", np.int32), ("at", np.uint16)))
            k = known_at(names, gram)
            at, k = at[np.repeat(k >= 0, n)], np.repeat(k[k >= 0], n[k >= 0])
            here = np.flatnonzero(np.bincount(at, minlength=1))
            found.append((asked["start"][i].as_py() + here, np.bincount(at, values[k], minlength=1)[here]))
        row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"row": row, "score": score})

    asked = docs.mapInArrow(work, "bucket long, start long, gram binary, n binary, at binary").groupBy("bucket")
    bucket = F.shiftrightunsigned("gram", 64 - bits)
    told = table.withColumn("bucket", bucket).where(F.col("bucket") % rounds(order) == nth_round).select("bucket", "gram", "value").groupBy("bucket")
    return asked.cogroup(told).applyInArrow(answer, "row long, score double").groupBy("row").agg(F.sum("score").alias("score"))


def add_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place that `at` names."""
    for b in batches:
        at = b.column(1).cast(pa.binary())
        k = np.frombuffer(pc.binary_length(at).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes(), dtype=np.int64) // 2
        place = np.frombuffer(b"".join(at.to_pylist()), dtype=np.uint16)
        of = np.repeat(np.arange(len(k)), k)
        told = pa.array(of)
        yield as_batch({"row": b.column(0).to_numpy()[of] + place, **{name: b.column(i).take(told) for i, name in enumerate(("doc_id", "n", "known", "base", "score"), 2)}})


def held_out() -> Column:
    return F.coalesce(crc_bucket(F.col("doc_id"), 10) == 0, F.lit(False))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bounded_batches(spark)
    counts, model = fit(docs.where(crc_bucket(F.col("doc_id"), 10) != 0).select("text"))
    found = score_texts(docs, counts, model, stored=True)
    drop(counts)
    drop(model["table"])
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(model["total"])).cast("long").alias("train_tokens"), "base_score", "score")
