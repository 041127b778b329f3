"""Weekend and night shifts: wording, wishes, denials, titles, snippets."""

import time

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import matches as M
from ledgerspark.operators import education
from ledgerspark.operators import shifts as S

CASES = [
    ("Technician", "Weekend shift required.", "weekend", None), ("Technician", "Works Saturday hours.", "weekend", None), ("Technician", "The gym is open on weekends.", None, None),
    ("Weekend Technician", "", "weekend", None), ("Technician, Weekends", "", "weekend", None), ("Technician", "Third shift, with a bonus.", None, "night"),
    ("Technician", "Overnight shifts.\nWeekend role.", "weekend", "night"), ("Technician", "No night shift.", None, None), ("Technician", "A night shift is not needed.", None, "night"),
    ("Technician", "Ideally a weekend shift.", None, None), ("Technician", "Preferred qualifications:\nNight shift", None, None), ("Technician", "Nice to have\nOther\nRequirements\nNight shift", None, "night"),
    ("Technician", "A bonus is paid. Required: night shifts", None, "night"), ("Technician", "No weekend shift. " + "x" * 40 + " Sunday schedule.", "weekend", None),
    ("No weekends", "", None, None), (None, None, None, None), ("", "", None, None), (None, "Graveyard shift" + " word" * 40_000, None, "night"),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(n, c[0], c[1], snippet) for n, c in enumerate(CASES) for snippet in (None, True)], "n int, title string, description string, snippet boolean")
    said = df.select("n", "snippet", S.stated(F.col("title"), F.col("description")).alias("said"))
    return said.select("n", "snippet", *(S.shift(F.col("said"), F.col("snippet"), p).alias(p) for p in S.RULED_OUT)).collect()


def test_shift(judged):
    for r in judged:
        _, _, weekend, night = CASES[r["n"]]
        clear = "clear" if weekend or night or not r["snippet"] else "unassessed"
        got = [r[p] and (r[p]["status"], r[p]["fact"]) for p in S.RULED_OUT]
        of = lambda fact: ("kill", fact) if fact else ("pass", clear)
        assert got == [of(weekend or night), of(weekend), of(night), None], CASES[r["n"]][:2]


def test_shift_reasons(judged):
    r = judged[0]
    assert r["no_weekends"]["reason"] == "shift preference no_weekends excludes weekend work: 'Technician Weekend shift required.'"
    assert r["no_nights"]["reason"] == "no excluded shift for preference no_nights"
    assert judged[10]["weekdays_only"]["reason"] == "shift preference weekdays_only excludes night shifts: 'Technician Third shift, with a bonus.'"


def test_shift_preferences():
    with pytest.raises(KeyError):
        S.shift(F.col("said"), F.lit(False), "mornings")


def test_shift_is_judged_to_the_first(spark):
    """What stands behind the first match that counts is not judged: each judgement reads the text up to its match."""
    title = F.lit("Technician")
    text = F.array_join(F.array_repeat(F.lit("Requirements:\nA night shift, a weekend shift."), 6_000), "\n")
    began = time.time()
    got = [r["said"] for r in spark.range(4).select(S.stated(title, F.concat(text, F.col("id").cast("string"))).alias("said")).collect()]
    assert all("night shift" in x["night"] and "weekend shift" in x["weekend"] for x in got) and time.time() - began < 30


def test_sections_of_odd_lines(spark):
    """Headings against a plain reading of all lines."""
    heads = ["Requirements", " required  Skills::", "Preferred qualifications :", "Minimum experience", "nice to have", "Bonus points for:", " SKILLS\r", "Skills\r:", "my skills", "skills x", "x" * 90 + " skills", " " * 95 + "skills", "preferred", "experience"]
    texts = ["\n".join(heads), "\n\n".join(reversed(heads)), "Required\nSkills", "skills\n", "\nskills", "", "\n", "a skills\nb\u0085skills", "\r\nSkills:\r\nx", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    label = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), ":+$", "")
    lines = F.filter(M.matches(t, r"[^\n]+"), lambda m: (m["end"] - m["start"] < 100) & label(m["quote"]).rlike(education.SECTION))
    plain = F.transform(lines, lambda m: F.struct(m["end"].alias("end"), m["quote"].rlike(education.PREFERENCE).alias("wish")))
    rows = df.select(education.sections(t).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and len(rows[0]["got"]) > 5
