"""Headlines, summaries and texts given to a label model. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendspark.functions import lexicon as L
from trendspark.functions import normalize as N
from trendspark.functions import text as X

#: Keys under which a leaked JSON object holds its prose, in order.
PROSE_KEYS = ["summary", "text", "description", "headline"]


def _sub(c: Column, pattern: str, plain: str, flags: str = "(?i)") -> Column:
    return F.regexp_replace(c, flags + pattern, plain)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of a value that is worked out once: a column that is written several times, or inside a lambda, is evaluated each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _small(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(",:;")).isin(*L.SMALL_WORDS)


def _tidy(c: Column, edges: str) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(edges))


def rewritten_title(source: Column, title: Column) -> Column:
    """The normal form of a title, hashtags of social feeds split, bait taken out, 350 characters at most."""
    plain = N.normalize_text(title)
    tag = source.isin("x_trends24", "tiktok") & F.startswith(plain, F.lit("#"))
    bare = _tidy(_sub(F.when(tag, N.split_hashtag(plain)).otherwise(plain), L.CLICKBAIT, " "), " -|:;,")
    return F.when(F.length(bare) > 350, X.excerpt(bare, 347)).otherwise(bare)


def clip(text: Column, limit: int) -> Column:
    return X.excerpt(N.normalize_text(text), limit)


def _title_word(word: Column, first: Column) -> Column:
    core = F.btrim(word, F.lit("\"'()"))
    capital = F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 1 << 30))
    model = F.concat(F.upper(F.substring_index(core, "-", 1)), F.regexp_extract(core, "(-.*)$", 1))
    kept = core.rlike("[0-9]") | (core.rlike("[A-Z]") & ~core.rlike("[a-z]")) | core.rlike("^.+[A-Z]")
    written = F.when(core.rlike(r"^[a-z]{2,4}-[0-9][\w.]*$"), model).when(kept, core).when(~first & F.lower(core).isin(*L.SMALL_WORDS), F.lower(core)).otherwise(capital)
    return F.when(core == "", word).otherwise(F.replace(word, core, written))


def sanitize_headline(text: Column, max_words: int = 10) -> Column:
    """A title in title case without links, handles, a leading category or, where it is cut, a dangling phrase.

    More than max_words (5 at least) words are cut to that number, then before the last small word among the last four
    (never among the first four words). Null gives an empty headline.
    """
    t = N.normalize_text(_sub(F.coalesce(text, F.lit("")), L.MD_LINK, "$1"))
    t = F.regexp_replace(_sub(_sub(t, L.BARE_URL, ""), L.HANDLE, ""), L.JSON_JUNK, " ")
    words = F.filter(F.split(_tidy(_sub(t, L.CATEGORY_PREFIX, ""), " .,;:-|\"'"), " "), lambda w: w != "")
    late = F.array(*map(F.lit, range(max(3, max_words - 5) + 1, max_words)))

    def cut(head: Column) -> Column:
        return F.coalesce(F.array_max(F.filter(late, lambda k: _small(F.get(head, k)))), F.lit(max_words))

    def short(head: Column, cut: Column) -> Column:
        kept = F.filter(F.array(*map(F.lit, range(max_words))), lambda k: (k < cut) & ~_small(F.get(head, k)))
        return F.slice(head, F.lit(1), F.coalesce(F.array_max(kept) + 1, F.lit(0)))

    def written(words: Column) -> Column:
        starts = lambda w, i: (i == 0) | w.rlike("^[\"'(]") | F.coalesce(F.endswith(F.get(words, i - 1), F.lit(":")), F.lit(False))
        return F.array_join(F.transform(words, lambda w, i: _title_word(w, starts(w, i))), " ")

    shortened = lambda w: _let(F.slice(w, 1, max_words), lambda head: _let(cut(head), lambda c: short(head, c)))
    words = _let(words, lambda w: F.when(F.size(w) > max_words, shortened(w)).otherwise(w))
    return F.btrim(_let(words, written), F.lit(" .,;:-"))


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def json_prose(text: Column) -> Column:
    """The prose in a leaked JSON value: a known key's string, else the longest of its strings; strings of a list joined; else the text.

    Values that are no strings (numbers, flags, nested objects and lists) don't count; an object without a string gives none.
    """
    return _let(text, lambda t: _let(F.trim(t), lambda bare: _let(F.try_parse_json(bare), lambda whole: _prose_of(t, bare, whole))))


def _prose_of(text: Column, bare: Column, whole: Column) -> Column:
    said = lambda v: F.when(_is_string(v), F.try_variant_get(v, "$", "string"))
    of_key = F.coalesce(*[said(F.try_variant_get(whole, f"$.{k}", "variant")) for k in PROSE_KEYS])
    strings = lambda values: F.filter(F.transform(values, said), lambda v: v.isNotNull())
    longest = F.aggregate(strings(F.map_values(F.from_json(bare, "map<string,variant>"))), F.lit(""), lambda a, v: F.when(F.length(v) > F.length(a), v).otherwise(a))
    listed = F.array_join(strings(F.from_json(bare, "array<variant>")), " ")
    return F.when(whole.isNull(), text).when(F.startswith(bare, F.lit("{")), F.coalesce(of_key, longest, F.lit(""))).when(F.startswith(bare, F.lit("[")), listed).otherwise(text)


def sanitize_summary(text: Column, entities: Column | None = None) -> Column:
    """Plain sentences: no links, handle signs or JSON leftovers; names as in entities; capitals and full stops.

    Sentences of fewer than three letters go. Null gives an empty summary.
    """
    t = _sub(json_prose(F.coalesce(text, F.lit(""))), L.MD_LINK, "$1")
    t = _sub(_sub(_sub(t, L.SAFE_URL, ""), L.JSON_KEY, " "), L.JSON_FRAGMENT, " ")
    t = _sub(_sub(_sub(N.normalize_text(t), L.TRAILING_URL, ""), L.BARE_URL, ""), L.HANDLE, "$1")
    t = F.regexp_replace(F.regexp_replace(t, L.JSON_JUNK, " "), r"\(\s*\)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s+([.,;:!?])", "$1")
    t = F.btrim(F.regexp_replace(t, r"([.,;:!?])(?:\s*[.,;:])+", "$1"), F.lit(" ,;:-|\"'"))
    held = lambda t, w: F.contains(t, F.lower(w))
    t = F.aggregate(F.array(*map(F.lit, L.PROPER_WORDS)), t, lambda t, w: F.when(held(t, w), F.regexp_replace(t, F.concat(F.lit(r"\b"), F.lower(w), F.lit(r"\b")), w)).otherwise(t))
    if entities is not None:
        quoted = lambda e: F.concat(F.lit(r"(?i)\b\Q"), e, F.lit(r"\E\b"))
        named = F.filter(F.transform(entities, F.trim), lambda e: (F.length(e) >= 3) & e.rlike("[A-Z]"))
        t = F.aggregate(named, t, lambda a, e: F.regexp_replace(a, quoted(e), F.regexp_replace(e, r"([\\$])", r"\\$1")))
    said = F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" ,;:-")))
    said = F.filter(said, lambda s: F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 3)
    closed = lambda s: F.when(s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))
    return F.array_join(F.transform(said, lambda s: closed(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))), " ")


def two_sentences(summary: Column, sources: Column, headline: Column, entities: Column | None = None) -> Column:
    """The first two sentences of a summary, filled up by ones that name the headline and the sources."""
    said = F.filter(F.transform(F.split(sanitize_summary(summary, entities), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), F.trim), lambda s: F.length(s) > 3)
    opening = F.concat(F.rtrim(headline, F.lit(".")), F.lit(L.OPENING))
    shown = N.display_sources(sources)
    closing = F.when(F.size(sources) > 1, F.concat(F.lit(L.CLOSING_MANY[0]), shown, F.lit(L.CLOSING_MANY[1]))).otherwise(F.concat(shown, F.lit(L.CLOSING_ONE)))
    padded = F.concat(_let(said, lambda s: F.when(F.size(s) == 0, F.array(opening)).otherwise(s)), F.array(closing))
    return sanitize_summary(F.array_join(F.slice(padded, 1, 2), " "), entities)


def is_insufficient(summary: Column, headline: Column) -> Column:
    said = F.coalesce(summary, F.lit(""))
    both = F.concat_ws(" ", F.coalesce(headline, F.lit("")), said)
    return both.rlike("(?i)" + L.INSUFFICIENT) | said.rlike("(?i)" + L.FILLER) | (N.normalize_text(said) == "")


def proper_nouns(text: Column) -> Column:
    """Names in a text in order, repeats included: runs of capitalised words that aren't blocked, a blocked first word dropped."""
    found = F.transform(F.regexp_extract_all(text, F.lit(L.PROPER_NOUN), F.lit(1)), lambda m: F.btrim(m, F.lit(" .'-")))
    found = F.filter(found, lambda m: (F.length(m) >= 2) & ~m.isin(*L.ENTITY_BLOCKLIST) & ~F.lower(m).isin(*L.STOP_WORDS))
    blocked = r"^(?:" + "|".join(L.ENTITY_BLOCKLIST) + r")\s+"
    return F.filter(F.transform(found, lambda m: F.regexp_replace(m, blocked, "")), lambda m: ~m.rlike("^[A-Z]{1,4}s$"))


def clean_entities(entities: Column, limit: int = 6) -> Column:
    """Entities as headlines of five words, those without a capital or digit or of a key met before dropped; limit at most."""
    pairs = F.transform(entities, lambda e: F.struct(sanitize_headline(e, 5).alias("e")))
    pairs = F.transform(pairs, lambda p: F.struct(p["e"].alias("e"), X.dedupe_key(p["e"]).alias("k")))
    good = F.filter(pairs, lambda p: (p["k"] != "") & ~p["k"].isin(*L.STOP_WORDS) & p["e"].rlike("[A-Z0-9]"))
    first = lambda g, keys: F.filter(g, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    kept = _let(good, lambda g: _let(F.transform(g, lambda p: p["k"]), lambda keys: first(g, keys)))
    return F.slice(F.transform(kept, lambda p: p["e"]), 1, limit)


def item_text(source: Column, title: Column, description: Column, news_titles: Column) -> Column:
    """A title with what names entities beside it: three news titles, or the first 200 characters of a description."""
    news = F.array_join(F.slice(F.coalesce(news_titles, F.array().cast("array<string>")), 1, 3), " ")
    more = F.when(source == "google_trends", news).when(source.isin("reddit", "producthunt"), F.substring(description, 1, 200))
    return N.normalize_text(F.concat_ws(" ", title, more))


def embedding_text(title: Column, context: Column, prefix: str = "clustering: ") -> Column:
    more = F.coalesce(F.substring(context, 1, 300), F.lit(""))
    return F.concat(F.lit(prefix), title, F.when(more != "", F.concat(F.lit(". "), more)).otherwise(""))


def prompt_line(source: Column, subreddit: Column, hint: Column, title: Column, context: Column, news_titles: Column, description: Column, limit: int = 160) -> Column:
    """`source | hint | title | context`, a context that repeats the title without it."""
    plain, ctx = N.normalize_text(title), N.normalize_text(context)
    bare = F.ltrim(F.substring(ctx, F.length(plain) + 1, F.lit(1 << 30)), F.lit(" .:-|"))
    ctx = F.when((plain != "") & F.startswith(F.lower(ctx), F.lower(plain)), bare).otherwise(ctx)
    news = F.when(source == "google_trends", F.nullif(F.array_join(F.slice(news_titles, 1, 2), " / "), F.lit("")))
    said = F.when(F.coalesce(context, F.lit("")) != "", ctx).otherwise(N.normalize_text(F.coalesce(news, description)))
    shown = F.coalesce(F.nullif(X.excerpt(said, limit), F.lit("")), F.lit("(no context)"))
    feed = F.when((source == "reddit") & (F.coalesce(subreddit, F.lit("")) != ""), F.concat(F.lit("reddit/r/"), subreddit)).otherwise(source)
    return F.concat_ws(" | ", feed, F.coalesce(hint, F.lit("-")), F.substring(title, 1, 200), shown)


def extract_json(text: Column) -> Column:
    """A model's JSON answer as a variant: as it is, from brace to brace, or after mending commas; a list under `clusters`.

    What holds no object gives null.
    """
    bare = F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*|\s*```$", "")
    mended = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r",\s*([}\]])", "$1"), r"([}\]\"0-9])\s*\n\s*([{\"\[])", "$1,\n$2"), r"\}\s*\{", "},{")
    good = lambda bare, braced: F.coalesce(*[_let(c, lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), F.trim(c))) for c in (bare, braced, mended(bare), mended(braced))])
    answer = _let(bare, lambda b: good(b, F.regexp_extract(b, r"(?s)(\{.*\})", 1)))
    return _let(answer, lambda a: F.when(F.startswith(a, F.lit("{")), F.try_parse_json(a)).when(F.startswith(a, F.lit("[")), F.try_parse_json(F.concat(F.lit('{"clusters":'), a, F.lit("}")))))
