"""Base spans against Python's re, terms against a plain count, and odd inputs."""

import hashlib
import math
import re

from trendspark.llm.pii import LEAST, SMOOTH, disclosing_terms, examined, find_pii, op2_pii, sanitized

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def holds(kind, match):
    d = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def slow(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in PATTERNS.items()}


def test_base_spans_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op2_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = slow(texts[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{z}" for k in PATTERNS for a, z in want[k])
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS]


ODD = [
    None, "", "a.b@c.d_e@f.g@h.i", "x@y", "1.2.3.4.5.6.7.8 and 999.1.1.1 and 0001.02.3.000255", "4539 1488 0343 6467, 4539-1488-0343-6468 4539148803436467 4539148803436467",
    "+1 (234) 567-8901 +123 +12345678 x +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é😀 a@b.co 😀 1.2.3.4", "a" * 20_000 + "@", "1" * 20_000, "1 " * 9_000, "x@" + "a." * 9_000 + "b", "+1" + "(" * 9_000,
]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a@b.co", None)], "doc_id long, text string, email string")
    for r in find_pii(df).collect():
        want = slow(ODD[r["doc_id"]] if r["doc_id"] is not None else "a@b.co")
        assert {k: [(s["start"], s["end"]) for s in r[k]] for k in PATTERNS} == want and r["term"] == []
    assert find_pii(df.where("false")).collect() == []


def slow_terms(texts):
    """Terms and disclosure by plain counts over distinct texts; ASCII words only."""
    texts = sorted({t or "" for t in texts})
    secret = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}"
    capital = r"[A-Z][a-z]{2,}(?![A-Za-z0-9])"
    words = [set(re.findall(rf"{secret}|(?<![A-Za-z0-9]){capital}", t)) for t in texts]
    found = [{(k, re.sub("[^0-9]", "", t[a:z]) if k in ("card", "phone") else t[a:z].lower()) for k, p in slow(t).items() for a, z in p} for t in texts]
    names = [set(re.findall(rf"(?<=[A-Za-z0-9,()] ){capital}", t)) if e else set() for t, e in zip(texts, found, strict=True)]
    n, out = len(texts), {}

    def tell(term, both, docs, of):
        info = math.log2(n / of)
        share = 1 + math.log2(both / (docs + SMOOTH)) / info if info > 0 else 0
        if share >= LEAST:
            out[term] = max(out.get(term, 0), share)

    count = lambda term: sum(term in w for w in words)
    for t in texts:
        for s in re.findall(secret, t):
            tell(s, count(s), count(s), count(s))
    for term in set().union(*names):
        for e in set().union(*found):
            both = sum(term in w and e in f for w, f in zip(names, found, strict=True))
            if both:
                tell(term, both, count(term), sum(e in f for f in found))
    return out


def test_terms_equal_a_plain_count(spark):
    fill = [f"plain text number{i} of the day with the common Words" for i in range(60)]
    told = [f"day{i} the surgeon Quillon wrote{i} from q@mail.example.com about{i} it" for i in range(6)]
    once = ["To ask for Brindle Oss, call +1 (234) 567-8901 at once", "Dr Brindle, of Words, has 10.0.0.7", "the Words of r@mail.example.com"] * 4
    keys = ["key = 0a1b2c3d4e5f60718293a4b5", "again 0a1b2c3d4e5f60718293a4b5 there", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"]
    rows = [(i, t) for i, t in enumerate(fill + told + once + keys + ["Quillon alone", None, "", "Quillon alone"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "'x' AS term", "2 AS words")
    terms = {r["term"]: r["disclosure"] for r in disclosing_terms(examined(df)).collect()}
    want = slow_terms([t for _, t in rows])
    assert set(terms) == set(want) and all(abs(terms[t] - want[t]) < 1e-9 for t in want)
    assert {"Quillon", "Oss", "0a1b2c3d4e5f60718293a4b5"} <= set(terms) and "Words" not in terms
    found = {r["doc_id"]: r for r in sanitized(find_pii(df)).collect()}
    assert found[len(rows) - 1]["clean_text"] == "[TERM] alone" and found[len(rows) - 3]["clean_text"] == ""
    assert "[EMAIL]" in found[60]["clean_text"] and "Quillon" not in found[60]["clean_text"]
    assert found[0]["clean_text"] == fill[0]


def test_terms_occur_in_the_test_tables(spark):
    assert sum(r["n_term"] for r in op2_pii(spark, SF).collect()) > 0
