"""Substring dedup against all windows of all texts, on planted and on odd rows."""

import random
import re
from collections import Counter

from trendspark.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts):
    """(words, kept text, removed spans) of each text, by counting every window."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + S.WINDOW]) for w in words for i in range(len(w) - S.WINDOW + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - S.WINDOW + 1):
            if seen[tuple(w[i : i + S.WINDOW])] > 1:
                gone[i : i + S.WINDOW] = [True] * S.WINDOW
        edge = [k for k in range(len(w) + 1) if (gone[k - 1] if k else False) != (gone[k] if k < len(w) else False)]
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), list(zip(edge[::2], edge[1::2], strict=True))))
    return out


def check(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    kinds = "".join(f", {k} string" for k in more)
    found = S.remove_repeats(spark.createDataFrame(rows, f"doc_id long, text string{kinds}"))
    assert found.columns == ["doc_id", "text", *(c for c in more if c not in S.ADDED), *S.ADDED]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"], [(x["start"], x["end"]) for x in r["removed_spans"]]) for r in found.collect()}
    assert got == dict(enumerate(plain(texts)))


def prose(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def test_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 3000)  # many blocks
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (34, 35, 36, 50, 90, 200)]
    texts = []
    for k in range(120):
        w = prose(rng, rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            p = passages[rng.randrange(len(passages))]
            a = rng.randrange(0, max(1, len(p) - 34)) if k % 3 else 0
            w[rng.randrange(len(w) + 1) : 0] = p[a : a + rng.choice([35, 60, len(p)])]
        texts.append(rng.choice([" ", "\n", "\t \r\n"]).join(w))
    near = prose(rng, 300)
    for _ in range(12):  # near copies
        near[rng.randrange(300)] = "other"
        texts.append(" ".join(near))
    texts += [texts[0]] * 3 + ["  ".join(passages[5] * 2)]
    check(spark, texts)


def test_odd_texts(spark):
    periodic = " ".join(["a"] * 80)
    texts = [None, "", " \n\t", "x", " ".join(["b"] * 34), " ".join(["b"] * 35), " ".join(["c"] * 36), periodic, periodic + " end", " ".join(["a", "b"] * 60), "é ü " * 40, "Case " * 36, "case " * 36, "y" * 200_000, "  \x1c".join(["m"] * 40)]
    check(spark, [*texts, *texts[:4]])
    check(spark, texts, block="old", anchors="old", n_words="old", Kept="x")


def test_no_rows(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_of_windows():
    words = [b"%d" % (i % 7) for i in range(200)]
    w = S.Windows([b" ".join(words)])
    high, low = w.names()
    names = {}
    for i in range(200 - S.WINDOW + 1):
        names.setdefault((high[i], low[i]), set()).add(tuple(words[i : i + S.WINDOW]))
    assert len(names) == 7 and all(len(x) == 1 for x in names.values())
    own = [tuple(words[i : i + S.ANCHOR]) for i in range(200 - S.ANCHOR + 1)]
    for i in range(len(w.anchor)):
        assert w.anchor[i] == min(w.gram[i : i + S.WINDOW - S.ANCHOR + 1])
    assert len(set(w.gram.tolist())) == len(set(own))
