"""Normal forms of texts, dates, ids and labels. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark.functions import text as X
from trendspark.functions.lexicon import CATEGORIES, CATEGORY_ALIASES, CATEGORY_PREFIX, GENERIC_HEADLINE_WORDS, SOURCE_DISPLAY

# Signs, patterns and edges.
#: Entities and signs with what stands for them, in order.
SIGNS = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", " - "), ("…", "...")]
_FOLDED = {c: b for c in map(chr, range(0xC0, 0x180)) if len(b := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}
#: Latin letters with a mark, and the letters without.
LATIN, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())
#: Patterns and what replaces them, in order, after the letters are folded.
CLEAN = [(r"[^\x00-\x7F]", ""), (r"(?i)https?://[^\s]+|www[.][^\s]+", " "), (r"[\x00-\x1F\x7F]", " "), (r"!{3,}", "!"), (r"[?]{3,}", "?"), (r"[.]{3,}", "."), (r" +", " ")]
EDGES = " -|:;,"


def normalize_text(text: Column) -> Column:
    """Plain ASCII on one line: common entities and signs replaced, Latin marks dropped, no URLs, no runs of `!?.` or spaces.

    A null text gives an empty one.
    """
    out = F.coalesce(text, F.lit(""))
    for sign, plain in SIGNS:
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return cleaned(F.translate(out, LATIN, PLAIN))


def cleaned(text: Column) -> Column:
    """The text without other than ASCII, URLs, control characters and runs of `!?.` or spaces, its edges trimmed."""
    out = text
    for pattern, plain in CLEAN:
        out = F.regexp_replace(out, pattern, plain)
    return F.btrim(out, F.lit(EDGES))


def split_hashtag(tag: Column) -> Column:
    """`#JordanLove` as `Jordan Love`, `#GBvsATL` as `GB vs ATL`; a text with a space loses its leading `#` only."""
    body = F.trim(F.regexp_replace(tag, "^#+", ""))
    spaced = F.regexp_replace(F.regexp_replace(body, "(?<=[A-Z])vs(?=[A-Z])", " vs "), "_", " ")
    spaced = F.regexp_replace(spaced, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.when(F.contains(body, F.lit(" ")), body).otherwise(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def coerce_category(raw: Column, fallback: str = "News") -> Column:
    """The category that raw names: itself, an alias, the first alias that it holds; fallback otherwise."""
    key = F.lower(normalize_text(raw))
    alias = [(a, c) for c, names in CATEGORY_ALIASES.items() for a in names]
    exact = F.create_map(*[F.lit(x) for a, c in ({a: c for a, c in alias} | {c.lower(): c for c in CATEGORIES}).items() for x in (a, c)])
    held = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in alias]), lambda s: F.contains(key, s["a"]))
    return F.when(F.coalesce(raw, F.lit("")) == "", fallback).otherwise(F.coalesce(F.try_element_at(exact, key), F.get(held, F.lit(0))["c"], F.lit(fallback)))


def is_generic_headline(headline: Column) -> Column:
    """Whether nothing but umbrella words is left after a category prefix."""
    words = X.significant_tokens(F.regexp_replace(F.coalesce(headline, F.lit("")), "(?i)" + CATEGORY_PREFIX, ""))
    return F.size(F.array_except(words, F.array(*map(F.lit, sorted(set(GENERIC_HEADLINE_WORDS)))))) == 0


def display_sources(names: Column) -> Column:
    """`A, B and C` by the names as shown; `one source` for none."""
    shown = F.create_map(*[F.lit(x) for kv in SOURCE_DISPLAY.items() for x in kv])
    names, n = F.transform(names, lambda s: F.coalesce(F.try_element_at(shown, s), s)), F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 0, "one source").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.get(names, n - 1)))


def safe_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit("")), F.lit("issue"))


def bar(share: Column, cells: int = 10) -> Column:
    """A bar of `#` for a share, clamped to 0..1, padded by `.`; halves round to even."""
    n = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * cells, 0).cast("int")
    return F.rpad(F.repeat(F.lit("#"), n), cells, ".")


def parse_datetime(text: Column, now: Column) -> Column:
    """RFC 822, then ISO 8601, else now; a time without a zone is one of the session's, UTC."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    tried = [F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")]
    return F.coalesce(*tried, plain.try_cast("timestamp"), now)


def coerce_ids(ids: Column) -> Column:
    """The entries of an array of texts that are whole numbers, as int."""
    return F.filter(F.transform(ids, lambda x: F.regexp_extract(x, "^ *#?([0-9]+) *$", 1).try_cast("int")), lambda x: x.isNotNull())


def relevance(raw: Column) -> Column:
    """A number of 1 to 10, halves to even; 5 for what is no number."""
    number = F.bround(raw.try_cast("double"), 0)
    return F.when(number.isNull() | F.isnan(number), 5).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(1.0), number)).cast("int"))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(X.dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
