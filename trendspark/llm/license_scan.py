"""License notices: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A window of a text spans as many shingles of SHINGLE words as the templates of its class have at most (a power of two, so at
most twice as many as any of them); windows overlap so far that some window holds at least 7/8 of any place a template could
be. Each of BANDS hash functions gives a window its least shingle hash; a window that agrees with a template on one function
is a candidate. A passage that holds at least CONTAINMENT of a template's shingles has, in that window, a Jaccard similarity
of at least 0.3 with it, and at 0.3 all of BANDS functions miss with the probability 0.003. Places of candidate windows are
verified by the words of their shingles, over a stretch as long as the template.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import bounded_batches, slices, text_bytes
from trendspark.llm.decontaminate import _FOLD
from trendspark.llm.license_texts import NOTICES
from trendspark.llm.textstats import Words, mix, words_of

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 16
#: Shingles of the least classes of templates, each of which takes those up to it; the others are the powers of two that follow.
LEAST_SIZES = (1, 4)
_SALT = np.random.default_rng(31).integers(1, 2**63, BANDS, dtype=np.uint64)
FOUND = "license string, n_shingles int, containment double, start int, end int"


def shingle_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the SHINGLE words from each word on, and whether they lie in one text."""
    n = len(w.hash)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h[: max(0, n - k)] += mix(w.hash[k:] + np.uint64(k))
    ok = np.zeros(n, dtype=bool)
    ok[: max(0, n - SHINGLE + 1)] = w.text[: max(0, n - SHINGLE + 1)] == w.text[SHINGLE - 1 :]
    return mix(h), ok


def _class(n: int) -> int:
    return next((k for k in LEAST_SIZES if n <= k), 1 << (n - 1).bit_length())


class Scanner:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT) -> None:
        names = sorted(templates)
        folded = [templates[k].encode().translate(_FOLD) for k in names]
        w = words_of(folded)
        h, ok = shingle_hashes(w)
        self.names = [k for i, k in enumerate(names) if (ok & (w.text == i)).any()]  # a notice under SHINGLE words has no shingle
        self.hashes = {k: np.unique(h[ok & (w.text == names.index(k))]) for k in self.names}
        said = dict(zip(names, (f.split() for f in folded), strict=True))
        self.shingles = {k: {tuple(said[k][i : i + SHINGLE]) for i in range(len(said[k]) - SHINGLE + 1)} for k in self.names}
        self.need = {k: containment * len(s) for k, s in self.shingles.items()}
        self.all = np.unique(np.concatenate(list(self.hashes.values()))) if self.names else np.zeros(0, dtype=np.uint64)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({_class(len(x)) for x in self.hashes.values()}):
            sign = np.stack([mix(x[:, None] ^ _SALT).min(axis=0) for x in self.hashes.values() if _class(len(x)) == size])
            flags = np.zeros((BANDS, 1 << 16), dtype=bool)
            for b in range(BANDS):
                flags[b, (sign[:, b] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.keys[size] = (sign, flags)

    def candidates(self, h: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """A mask of the shingles that some window holds which agrees with some template in a band."""
        mask = np.zeros(len(h) + 1, dtype=np.int64)
        for b in range(BANDS):
            least, span = mix(h ^ _SALT[b]), 1
            least[~ok] = np.uint64(2**64 - 1)
            for size, (sign, flags) in self.keys.items():  # ascending: each window is the least of two halves
                while span < size:
                    least[: len(least) - span] = np.minimum(least[: len(least) - span], least[span:])
                    span *= 2
                here = least[:: max(1, size // 8)]
                maybe = np.flatnonzero(flags[b, (here & np.uint64(0xFFFF)).astype(np.int64)])
                at = maybe[np.isin(here[maybe], sign[:, b])] * max(1, size // 8)
                np.add.at(mask, at, 1)
                np.add.at(mask, np.minimum(len(h), at + size), -1)
        return np.cumsum(mask[:-1]) > 0

    def best_place(self, name: str, places: list[int], said: list[tuple[bytes, ...]]) -> tuple[int, int, int]:
        """(distinct shingles of the template, first and last place) of the fullest stretch of a quarter more than its length."""
        best, lo, seen, reach = (0, 0, 0), 0, Counter(), len(self.shingles[name]) * 5 // 4 + 1
        for hi, p in enumerate(places):
            seen[said[hi]] += 1
            while p - places[lo] >= reach:
                seen[said[lo]] -= 1
                if not seen[said[lo]]:
                    del seen[said[lo]]
                lo += 1
            if len(seen) > best[0]:
                best = (len(seen), places[lo], p)
        return best

    def __call__(self, texts: list[bytes]) -> list[list[dict]]:
        """For each text the notices it holds, by name: best share of shingles and bytes of that place."""
        out: list[list[dict]] = [[] for _ in texts]
        folded = [t.translate(_FOLD) for t in texts]
        w = words_of(folded)
        if not len(w.hash) or not self.keys:
            return out
        h, ok = shingle_hashes(w)
        known = ok & np.isin(h, self.all)
        hit = np.flatnonzero(self.candidates(h, ok) & known)
        begins = np.cumsum(w.n) - w.n
        cuts = np.flatnonzero(np.append(True, w.text[hit][1:] != w.text[hit][:-1])[: len(hit)])
        for at in np.split(hit, cuts[1:]) if len(hit) else []:
            text = int(w.text[at[0]])
            # A window may begin or end within the place: known shingles around it belong to it too.
            at = np.unique(np.concatenate([at + d for d in range(-SHINGLE + 1, SHINGLE)]))
            at = at[(at >= begins[text]) & (at < begins[text] + w.n[text])]
            at = at[known[at]]
            base = w.offsets[text]
            word = lambda i: folded[text][w.start[i] - base : w.end[i] - base]  # noqa: B023, E731
            for name in self.names:
                own = at[np.isin(h[at], self.hashes[name])]
                if len(own) < self.need[name]:
                    continue
                said = [tuple(word(p + k) for k in range(SHINGLE)) for p in own.tolist()]
                same = [(p, x) for p, x in zip(own.tolist(), said, strict=True) if x in self.shingles[name]]
                best = self.best_place(name, [p for p, _ in same], [x for _, x in same])
                if best[0] and best[0] >= self.need[name]:
                    end = int(w.end[min(best[2] + SHINGLE, len(w.end)) - 1] - base)
                    share = best[0] / len(self.shingles[name])
                    out[text].append({"license": name, "n_shingles": best[0], "containment": share, "start": int(w.start[best[1]] - base), "end": end})
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, n_shingles, containment, start, end): one row for each row of docs and notice it holds.

    start and end are code points of the best place. A null text or one of fewer than SHINGLE words holds nothing. Repeated
    rows have rows of their own. Other columns don't matter. Templates are few and given by the caller, not data.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Scanner(templates or NOTICES, containment))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = text_bytes(b.column(1)), []
            for i, found in enumerate(found for some in slices(texts) for found in shared.value(some)):
                for f in found:
                    points = lambda k: len(texts[i][:k].decode("utf-8", "replace"))  # noqa: B023, E731
                    rows.append((b.column(0)[i].as_py(), f["license"], f["n_shingles"], f["containment"], points(f["start"]), points(f["end"])))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "license", "n_shingles", "containment", "start", "end"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, f"doc_id long, {FOUND}")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
