"""Names in one pass against Python's own alternation, letters, and withholding."""

import re
import time

from pyspark.sql import functions as F

from ledgerspark.operators import placeholders as P
from ledgerspark.plans import postings

D = "/root/testdata/sf0.001"


def plain(text, names):
    by = {n.lower(): p for n, p in names}
    body = "|".join(re.escape(n) for n in sorted(by, key=lambda n: (-len(n), n)))
    return re.sub(rf"(?<!\w)(?:{body})(?!\w)", lambda m: by[m[0].lower()], text, flags=re.I) if by and text else text


def scrubbed(spark, texts, names):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    known = spark.createDataFrame(names, "name string, placeholder string")
    return {r["key"]: (r["text"], r["withheld"]) for r in P.scrubbed(rows, "key", "text", known).collect()}


def test_names(spark):
    names = [("Acme", "Organisation A"), ("Acme Labs", "Organisation B"), ("Institution", "Organisation C"), ("State University", "Institution A"), ("A&B Co", "Organisation D"), ("O'Neill", "Organisation E"), ("labs of", "Organisation F"), ("São Paulo", "Organisation G")]
    texts = ["At ACME labs of Acme", "acmes Acme_x Acme-x (acme)", "State University, an Institution", "a&b co and O'NEILL's", "são paulo São  Paulo", "", None, "nothing here", "Acme Labs Acme Labs", "labs of labs of acme labs of"]
    assert scrubbed(spark, texts, names) == {i: (plain(t, names), None) for i, t in enumerate(texts)}
    assert scrubbed(spark, texts, []) == {i: (t, None) for i, t in enumerate(texts)} and scrubbed(spark, [], names) == {}


def test_withheld(spark):
    texts = ["She led it", "the shed", "born in Acme", "Women  in tech", "women in tech", "Hers and age", "packaged", "the Temple of Acme"]
    got = scrubbed(spark, texts, [("Temple of Acme", "Organisation A")])
    assert got == {0: (P.WITHHELD, "pronoun"), 1: ("the shed", None), 2: (P.WITHHELD, "protected_term"), 3: ("Women  in tech", None), 4: (P.WITHHELD, "protected_term"), 5: (P.WITHHELD, "pronoun"), 6: ("packaged", None), 7: ("the Organisation A", None)}


def test_ten_thousand_names(spark):
    names = [(f"name{i} of {i % 97}", f"Organisation {i}") for i in range(10_000)] + [("of", "Organisation OF")]
    texts = [f"x name{i * 37 % 12_000} of {i * 37 % 97} y of name{i}" for i in range(500)]
    assert scrubbed(spark, texts, names) == {i: (plain(t, names[:0] + names), None) for i, t in enumerate(texts)}


def test_long_text(spark):
    """A text of 40,000 words, half of them names: linear in the words, where an array that grew by each word took minutes."""
    names = [("of", "Organisation A"), ("of the", "Organisation B")]
    text = " ".join(f"w{i} of" + " the" * (i % 3) for i in range(20_000))
    began = time.time()
    assert scrubbed(spark, [text], names) == {0: (plain(text, names), None)}
    assert time.time() - began < 30


def test_letters_and_order(spark):
    n = [0, 25, 26, 27, 701, 702, 18277, 18278]
    assert [r[0] for r in spark.createDataFrame([(i,) for i in n], "i int").select(P.letters(F.col("i"))).collect()] == ["A", "Z", "AA", "AB", "ZZ", "AAA", "ZZZ", "AAAA"]
    rows = [("Organisation", "Acme", 3), ("Organisation", "ACME", 9), ("Institution", "State", 1), ("Organisation", "Beta", 2), ("Organisation", " ", 4), ("Organisation", None, 5), ("Institution", "acme", 6)]
    got = {tuple(r) for r in P.named(spark.createDataFrame(rows, "kind string, name string, at long"), "at").collect()}
    assert got == {("acme", "Organisation B"), ("beta", "Organisation A"), ("state", "Institution A")}


def test_query(spark):
    names = [tuple(r) for r in P.named(postings.names_known(spark, D), "at").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["text"], r["withheld"]) for r in postings.placeholders(spark, D).collect()}
    deny = lambda t: next((c for c, terms in (("pronoun", P.PRONOUNS), ("protected_term", P.PROTECTED)) if re.search(r"(?<!\w)(?:" + "|".join(map(re.escape, terms)) + r")(?!\w)", t or "", re.I)), None)
    want = {i: plain(t, names) for i, t in texts.items()}
    assert got == {i: (P.WITHHELD if deny(t) else t, deny(t)) for i, t in want.items()} and sum(t != texts[i] for i, t in want.items()) > 50
