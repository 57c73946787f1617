"""Personal data: fixed patterns, and terms that reveal the entities behind them.

All of it is DataFrame functions. The patterns give the base spans. The method is information-theoretic sanitisation: each
distinct address or number is a protected entity e, whose information is -log2 p(e). Candidate terms are the name-like words
of the documents that hold an entity, wherever they stand in them: words that begin with a capital inside a sentence. Over
the whole corpus of distinct texts, a term t in n(t) of them, n(t, e) of which hold e, tells e with the probability
n(t, e) / (n(t) + SMOOTH), smoothed so that one text is weaker evidence than many; it discloses the part
1 + log2(that) / -log2 p(e) of e's information. A secret (a long word of letters and digits) is an entity of its own, of n(t)
texts. A term that discloses at least LEAST is a span wherever it occurs, and `sanitized` generalises it to its class or
removes it.

Candidate words are taken from each text once and written with its base spans; a term of one text alone needs no pairs with
that text's entities, only the most informative of them, and pairs are formed for the other terms that could pass at all.

The patterns are rewritten without changing what they match, so that long runs cost no more than their length: a match
may only start where the run before it starts (or where the last match ended), and quantifiers that never need to give
back are possessive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.session import materialize

_LOCAL = r"A-Za-z0-9._%+-"
#: Fixed patterns, in the order in which spans are listed.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TERM = "term"
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"
_WORD = r"[\p{L}\p{M}\p{N}]"
_SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"
_CAPITAL = rf"\p{{Lu}}[\p{{Ll}}\p{{M}}]{{2,}}+(?!{_WORD})"
#: Words that may be terms; those of them that are names inside a sentence, after a word, a comma or a bracket.
WORDS = rf"{_SECRET}|(?<!{_WORD}){_CAPITAL}"
INSIDE = rf"(?<=[\p{{L}}\p{{N}},()] ){_CAPITAL}"

SMOOTH, LEAST = 0.5, 0.85
#: Rows up to which a table of terms or of texts with terms is broadcast (some 60 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def _luhn(digits: Column) -> Column:
    def each(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), each), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(n.between(16, 19), _luhn(digits)).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def located(text: Column, pattern: Column | str, kind: str) -> Column:
    """All matches as spans, by the lengths of the pieces between them; code points, end exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).cast("long").alias("gap"), v.alias("value")))  # the last gap has no match

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(F.when(x["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"), F.coalesce(end, start).alias("at"))

    begin = F.struct(F.array().cast(SPAN).alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(both, begin, step, lambda acc: acc["out"])


def base_spans(text: Column, kind: str) -> Column:
    pattern, needs = PATTERNS[kind], _NEEDS[kind]
    has = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return F.when(has, F.filter(located(text, pattern, kind), lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def examined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, email, ip, card, phone, words, secrets, names), a row for each row of docs, written out; h stands for the text.

    words: the distinct words that may be terms; secrets; names: those inside a sentence, of texts that hold an entity.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    rows = rows.select("doc_id", "t", F.xxhash64("t").alias("h"), *[base_spans(F.col("t"), k).alias(k) for k in PATTERNS])
    some = F.lit(False)
    for k in PATTERNS:
        some = some | (F.size(k) > 0)
    each = lambda pattern: F.array_distinct(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    none = F.array().cast("array<string>")
    has_digit = F.col("t").rlike("[0-9]")
    rows = rows.select("doc_id", "h", *PATTERNS, each(WORDS).alias("words"), F.when(has_digit, each(_SECRET)).otherwise(none).alias("secrets"), F.when(some, each(INSIDE)).otherwise(none).alias("names"))
    return materialize(rows, "pii-examined")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; df must be a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def disclosing_terms(seen: DataFrame, least: float = LEAST) -> DataFrame:
    """(term, disclosure) of the terms that disclose at least `least` of some entity, by all rows of `examined`; written out.

    Documents with the same text count once.
    """
    entities = F.array_distinct(F.transform(F.concat(*PATTERNS), _entity))
    whole = seen.groupBy("h").count().count()  # distinct texts
    total = float(max(1, whole))
    held = seen.where(F.size(F.concat(*PATTERNS)) > 0).select("h", F.explode(entities).alias("e"))
    held = materialize(held.distinct(), "pii-entities")
    e_docs = held.groupBy("e").agg(F.count("*").alias("e_docs")).withColumn("info", F.log2(F.lit(total) / F.col("e_docs")))
    e_docs = materialize(e_docs, "pii-information")
    most = e_docs.agg(F.max("e_docs")).first()[0] or 0
    named = materialize(seen.select("h", F.explode("names").alias("term")).distinct(), "pii-names")
    candidates = seen.select(F.explode("secrets").alias("term")).union(named.select("term")).distinct()
    candidates = materialize(candidates, "pii-candidates")
    occurs = seen.select("h", F.explode("words").alias("term")).join(_small(candidates), "term", "left_semi").distinct()
    t_docs = occurs.groupBy("term").agg(F.count("*").alias("t_docs"), F.min("h").alias("alone"))
    t_docs = materialize(t_docs, "pii-counts")

    def share(both: Column | str, info: Column) -> Column:
        told = 1 + F.log2(F.expr(str(both)) / (F.col("t_docs") + SMOOTH)) / info
        return F.when(info > 0, told).otherwise(0.0)

    secret = seen.select(F.explode("secrets").alias("term")).distinct().join(t_docs, "term")
    secret = secret.select("term", share("t_docs", F.log2(F.lit(total) / F.col("t_docs"))).alias("share"))
    # A term of one text: the entity of that text with the most information tells the most.
    top = held.join(e_docs, "e").groupBy("h").agg(F.max("info").alias("info"))
    single = named.join(t_docs.where("t_docs = 1").select("term", "t_docs"), "term").join(top, "h").select("term", share("1", F.col("info")).alias("share"))
    # Of the others only those in few enough texts can pass: n(t, e) is at most e_docs.
    bound = float(most) ** least * total ** (1 - least)
    several = named.join(t_docs.where((F.col("t_docs") > 1) & (F.col("t_docs") + SMOOTH <= bound + 1e-6)).select("term", "t_docs"), "term")
    together = several.join(held, "h").groupBy("term", "e", "t_docs").agg(F.count("*").alias("both")).join(e_docs, "e")
    together = together.select("term", share("both", F.col("info")).alias("share"))
    told = secret.union(single).union(together).where(F.col("share") >= least)
    return materialize(told.groupBy("term").agg(F.max("share").alias("disclosure")), "pii-terms")


def term_spans(docs: DataFrame, seen: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, term): the spans of terms in each distinct text that has some, without those that touch a base span; written out."""
    hits = seen.select("h", F.explode("words").alias("term")).join(_small(terms.select("term")), "term", "left_semi").distinct()
    # A text's list is bounded by its own words, and copies of a text don't meet in one group.
    hits = materialize(hits.groupBy("h").agg(F.collect_list("term").alias("terms")), "pii-hits")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(text.alias("t"), F.xxhash64(text).alias("h")).join(_small(hits), "h")
    found = F.filter(located(F.col("t"), WORDS, TERM), lambda s: F.array_contains(F.col("terms"), s["value"]))
    spans = texts.select("h", found.alias("spans")).groupBy("h").agg(F.first("spans").alias("spans"))
    base = seen.join(_small(hits.select("h")), "h", "left_semi").groupBy("h").agg(F.first(F.concat(*PATTERNS)).alias("base"))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return materialize(spans.join(base, "h").select("h", F.filter("spans", apart).alias(TERM)), "pii-spans")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, email, ip, card, phone, term): one row for each row of docs; each kind an array of spans in order.

    A null text is empty and has no spans. Rows that repeat are treated alike. Other columns don't matter.
    Term spans that touch a base span are left out; base spans are never changed.
    """
    seen = examined(docs, id_col, text_col)
    found = term_spans(docs, seen, disclosing_terms(seen), text_col)
    spans = F.coalesce(TERM, F.array().cast(SPAN)).alias(TERM)
    return seen.select("doc_id", "h", *PATTERNS).join(_small(found), "h", "left").select("doc_id", "h", *PATTERNS, spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_spans and the text: (doc_id, text, email, ip, card, phone, term)."""
    kinds = (*PATTERNS, TERM)
    each = find_spans(docs, id_col, text_col).groupBy("h").agg(*[F.first(k).alias(k) for k in kinds])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return rows.join(materialize(each, "pii-texts"), "h").select("doc_id", "text", *kinds)


def sanitized(found: DataFrame, remove_terms: bool = False) -> DataFrame:
    """find_pii's result with clean_text: each base span becomes its kind in brackets, each term [TERM] or nothing."""
    spans = F.array_sort(F.concat(*[F.col(k) for k in (*PATTERNS, TERM)]), lambda a, b: F.coalesce(F.nullif(F.signum(a["start"] - b["start"]), F.lit(0.0)), F.signum(b["end"] - a["end"])).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        later = s["start"] >= acc["at"]
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        named = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        named = F.when(s["kind"] == TERM, F.lit("")).otherwise(named) if remove_terms else named
        text = F.when(later, F.concat(acc["out"], piece, named)).otherwise(acc["out"])
        return F.struct(text.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    return found.withColumn("clean_text", F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, end))


def _joined(*kinds: str) -> Column:
    return F.concat_ws(",", F.transform(F.concat(*[F.col(k) for k in kinds]), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*PATTERNS, TERM)]
    base = F.sha2(_joined(*PATTERNS).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:4], base, _joined(*PATTERNS, TERM).alias("spans"), counts[4])
