"""Steps that cost a text, a word or a run more than they need, held to plans; and passes over whole texts against those by rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import assessment as A
from ledgerspark.operators import requirements as R
from ledgerspark.plans import postings, state
from ledgerspark.sources import paged

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_texts(n):
    """Texts of words and marks that patterns, words and lines may take otherwise."""
    pieces = [
        "Requirements:", "requirements and skills", "Duties", "Key responsibilities ", "[section break]", "Preferred things:", "About us", "required", "must", "MUſT", "mİnımum", "not required", "no such thing is required", "need not", "needs", "need²", "must́", "at least", "optional", "plus",
        "employment is contingent", "only those eligible for this role", "We use", "our team builds", "The platform runs", "you", "sKills", "a Ⓑ must", "must‍", "‿must", "\x1cmust", "and", "/", "&", ".", ". ", "! ", ",", ":", "::", "\n", "\n", "\n", "\r", "\x85", " ", "　", "\xa0", "  ", "\t", "x" * 90, "é" * 130 + ". ", "🄰", "日本", "_", "",
    ]
    r = random.Random(4)
    return ["".join(r.choice(pieces) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randrange(40))) for _ in range(n)]


def test_spans_by_texts_and_by_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*odd_texts(3000), "", None])], "key long, text string").union(spark.read.parquet(f"{D}/documents.parquet").select(F.col("doc_id") + 10_000, postings.posting(F.col("text"))))
    kept = ("key", "span", "start", "end", "text", "heading", "hint")
    by_rows = {tuple(r) for r in R.spans(R.lines(docs, "key", "text"), "key").select(*kept).collect()}
    got = R.text_spans(docs, "key", "text").select(*kept)
    assert {tuple(r) for r in got.collect()} == by_rows and len(by_rows) > 3000 and {r[6] for r in by_rows} == {"required", "preferred", "unknown"}
    titled = R.text_spans(docs, "key", "text", title=True).where("span = 0")
    assert {r["key"]: r["text"] for r in titled.collect()} == {r["key"]: r["t"] for r in docs.select("key", F.substring_index("text", "\n", 1).alias("t")).collect()}


def fits(spark):
    facts = [("1", "R", "skill"), ("2", "data_science and C++", "skill"), ("3", "Machine  learning\tat scale", "project"), ("4", "İstanbul office, must", "role"), ("5", "ΟΔΟΣ ΑΒ", "skill"), ("6", "é must plus", None), ("7", "R", None), ("8", "Straße 3 must and plus", "skill"), ("9", "required must at least", "skill")]
    pieces = ["r", "R", "data_science", "data science", "and", "C++", "c++,", "machine", "learning", "LEARNING\t", "\n", "İstanbul", "i̇stanbul", "office", ",", "ΟΔΟΣ", "οδος", "ΑΒ", "É", "must", "plus", "straße", "STRASSE", "3", "_", "don’t", "x-r", "x.", "required", "at least", "as well as", ", and ", "AND", "license"]
    r = random.Random(5)
    texts = [r.choice(["", " ", "  "]).join(r.choice(pieces) + r.choice(["", " ", " ", "_"]) for _ in range(r.randrange(30))) for _ in range(3000)]
    contexts = spark.createDataFrame([(i // 3, i, "required", t) for i, t in enumerate([*texts, "", None])], "key long, context int, source string, text string")
    return contexts, A.index(spark.createDataFrame(facts, "fact string, value string, kind string"))


def rows(df):
    return {(r["context"], *map(str, (r["source"], r["text"], r["found"], r["gaps"], r["asks_credential"], r["evidence"]))) for r in df.collect()}


def test_facts_held_and_joined(spark, monkeypatch):
    contexts, index = fits(spark)
    joined = rows(A.assessed(contexts, A.matched(contexts, index, "key"), "key"))
    held = A.fitted(contexts, index, "key")
    assert rows(held) == joined and held.agg(F.sum(F.size("found"))).first()[0] > 1000 and "Join" not in plan(held) and "Exchange" not in plan(held)
    monkeypatch.setattr(A, "MOST_HELD", 3)
    assert "Join" in plan(A.fitted(contexts, index, "key")) and rows(A.fitted(contexts, index, "key")) == joined


def test_contexts_shuffle_texts_once(spark):
    """Each text is dealt once, and no line, word or run of words of it is a row of a shuffle, a window or a join."""
    text = plan(postings.fit_rows(spark, D))
    assert text.count("Exchange") == 1 and not any(step in text for step in ("Window", "Join", "Generate", "Sort"))


def test_evidence_reads_no_clauses(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(A, "fitted", lambda contexts, index, key, gaps=True: asked.append(gaps) or fitted(contexts, index, key, gaps))
    text = plan(postings.assessment_evidence(spark, D))
    assert asked == [False] and text.count("Exchange") == 1 and "Join" not in text and "Window" not in text
    contexts, index = fits(spark)
    assert fitted(contexts, index, "key", gaps=False).where("gaps is not null").count() == 0


fitted = A.fitted


def test_postings_by_pieces(spark):
    """What stands between spaces is reworded by itself, and lines are those of the native patterns."""
    texts = ["The cat. of The²the. a  THE,of;", "that.\r", " that.", "that. ", ".", "x.", "a b.", "a b.  of", " b.", "a .", "a b.\x85", "a\rb.\r", "a b.\x85\r", "", "of\nthe. \n.", "no-the. the_of ofthe é.", None]
    low = {k: v for k, v in postings.WORDS.items()}
    parts = F.transform(F.regexp_extract_all("t", F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in low.items() for x in p)), F.lower(w)), w))
    lines = F.transform(F.split(F.regexp_replace(F.array_join(parts, ""), r"\. +", ".\n"), "\n", -1), lambda x: F.when(x.rlike(r"^[^ ]+\.$"), "Requirements:").when(x.rlike(r"^[^ ]+ [^ ]+\.$"), "Responsibilities:").otherwise(x))
    df = spark.createDataFrame([(t,) for t in [*texts, *odd_texts(2000)]], "t string")
    assert df.select(postings.posting(F.col("t")).alias("got"), F.array_join(lines, "\n").alias("want")).where("not got <=> want").collect() == []


def listing(spark, boards):
    """Boards of entries, by place; None is an entry without a key, a place that is not there is a gap."""
    rows = [(b, n, k, f"/{k}", None) for b, keys in boards.items() for n, k in enumerate(keys) if k != "gap"]
    return spark.createDataFrame(rows, "board string, place long, key string, path string, row string")


def runs_one_by_one(spark, path, boards, fetch, limit, pages):
    while paged.advance(spark, path, boards, fetch, "t", limit, pages):
        pass


@pytest.mark.parametrize("ahead", [1, 2, 16])
def test_runs_at_once(spark, tmp_path, ahead):
    keys = lambda n, first=0: [f"k{i}" for i in range(first, first + n)]
    boards = {"whole": keys(13), "even": keys(8), "short": keys(1), "stalls": keys(4) + keys(2, 2) + keys(9, 50), "again": keys(5) + keys(1) * 2, "blank": keys(6) + [None, " "] + keys(7, 6), "gap": keys(5) + ["gap"] + keys(9, 5), "hole": keys(4) + ["gap"] * 8 + keys(3, 4)}
    names = spark.createDataFrame([(b,) for b in [*boards, "nothing", "short", None]], "board string")
    fetch = paged.recorded(listing(spark, boards))
    one, many = f"file://{tmp_path}/one", f"file://{tmp_path}/many"
    runs_one_by_one(spark, one, names, fetch, 2, 2)
    paged.scan(spark, many, names, fetch, "t", 2, 2, ahead)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(paged.seen(spark, many)) == rows(paged.seen(spark, one)) and rows(paged.cursors(spark, many)) == rows(paged.cursors(spark, one))
    assert len({r["status"] for r in paged.cursors(spark, one).collect()}) > 2 and paged.seen(spark, one).agg(F.max("run")).first()[0] >= 3
    before = rows(paged.seen(spark, many))
    paged.scan(spark, many, names.where("board = 'whole'"), fetch, "t", 2, 2)  # read to its end: left alone
    assert rows(paged.seen(spark, many)) == before


def test_runs_at_once_that_die(spark, tmp_path):
    path, names = f"file://{tmp_path}/scan", spark.createDataFrame([("b",)], "board string")
    fetch = paged.recorded(listing(spark, {"b": [f"k{i}" for i in range(30)]}))
    paged.advance(spark, path, names, fetch, "t", 2, 2)
    paged.scan(spark, path, names, fetch, "t", 2, 2)
    assert sorted(p.name for p in tmp_path.glob("scan/*")) == ["run=0", "runs=1-7"] and paged.cursors(spark, path).first()["status"] == "complete"
    (tmp_path / "scan" / "runs=1-7" / "_SUCCESS").unlink()
    assert paged.cursors(spark, path).first()["next_offset"] == 4 and paged.seen(spark, path).count() == 4
    paged.scan(spark, path, names, fetch, "t", 2, 2, ahead=3)
    assert paged.seen(spark, path).groupBy("run").count().count() == 8 and paged.seen(spark, path).count() == 30


def test_paged_scan_is_few_rounds(spark, tmp_path, monkeypatch):
    """However many runs a listing needs, it is written once and read in few rounds."""
    spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", F.lit("http://one.example.com/x").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    listings, rounds = [], []

    def counted(df, recorded=paged.recorded):
        listings.append(1)
        fetch = recorded(df)
        return lambda wanted: rounds.append(1) or fetch(wanted)

    monkeypatch.setattr(paged, "recorded", counted)
    got = state.paged_scan(spark, str(tmp_path))
    assert got.agg(F.count("*"), F.countDistinct("page_id"), F.max("run")).first()[:] == (2500, 2500, 12) and (len(listings), len(rounds)) == (1, 1)
