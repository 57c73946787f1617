"""Column builders for titles, counts and ids. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark.functions.lexicon import MOMENTUM, STOP_WORDS, TOKEN


def dedupe_key(title: Column) -> Column:
    """Lower case, other than a-z, 0-9 and space to space, runs of spaces to one, one leading `the ` dropped."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]+", " "), " +", " ")
    return F.regexp_replace(F.trim(plain), "^the ", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def significant_tokens(text: Column) -> Column:
    """Distinct tokens of three characters or more that are no stop word and not all digits."""
    keep = lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$")
    return F.array_except(F.filter(tokens(text), keep), F.array(*map(F.lit, sorted(set(STOP_WORDS)))))


def excerpt(text: Column, limit: int) -> Column:
    """The text if it is no longer than limit, else cut at the last space before it, stripped of ` ,;:-`, with dots."""
    head = F.substring(text, 1, limit)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:-]+$", ""), F.lit("...")))


def parse_count(text: Column) -> Column:
    """`12.3K`, `1,204`, `200+`, `2M`, `1B` as a number; null where there is none."""
    plain = F.regexp_replace(F.upper(F.trim(text)), "[,+ ]", "")
    number = F.regexp_extract(plain, "^([0-9]*[.]?[0-9]+)", 1).try_cast("double")
    scale = F.regexp_extract(plain, "^[0-9]*[.]?[0-9]+([KMB])", 1)
    return number * F.when(scale == "K", 1e3).when(scale == "M", 1e6).when(scale == "B", 1e9).otherwise(1.0)


def content_hash(source: Column, title: Column, url: Column) -> Column:
    return F.sha1(F.concat_ws("|", source, F.lower(F.trim(title)), F.coalesce(url, F.lit(""))).cast("binary"))


def cluster_id(entities: Column, headline: Column) -> Column:
    """12 hex digits of the sorted distinct lower-case entities, of the headline where there are none."""
    names = F.array_sort(F.array_distinct(F.transform(entities, lambda e: F.lower(F.trim(e)))))
    return F.substring(F.sha1(F.when(F.size(names) > 0, F.array_join(names, "|")).otherwise(F.lower(F.trim(headline))).cast("binary")), 1, 12)


def momentum(velocity: Column, is_new: Column, cold: Column) -> Column:
    out = F.when(cold, "BASELINE").when(is_new, "NEW")
    for bound, name in MOMENTUM:
        out = out.when(velocity > bound if name == "STEADY" else velocity >= bound, name)
    return out.otherwise("FADING")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
