"""Weekend and night shifts that a text states, against what a candidate works; Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions import matches as M
from ledgerspark.functions.text import excerpt
from ledgerspark.operators import authorization, education

#: Wording of shifts, anywhere and in a title alone, and what each preference rules out.
WEEKEND = r"(?iU)\bweekend(?:s)?\s+(?:shift|schedule|hours|position|role|technician|tech)\b|\b(?:saturday|sunday)\s+(?:shift|schedule|hours)\b"
WEEKEND_TITLE = r"(?iU)\bweekend(?:s)?\b"
NIGHT = r"(?iU)\b(?:nights?|overnight|graveyard|third)\s+shifts?\b"
RULED_OUT = {"weekdays_only": ("weekend", "night"), "no_weekends": ("weekend",), "no_nights": ("night",), "no_preference": ()}


def _found(text: Column, pattern: str) -> Column:
    """The matches of pattern; null if there is none."""
    return F.when(text.rlike(pattern), M.matches(text, pattern))


def _first(text: Column, found: Column, headings: Column) -> Column:
    """The first of matches that is neither a wish nor denied, those behind it are not judged; null if there is none."""
    stands = lambda m: ~authorization.denied(text, m["start"], m["quote"]) & ~education.wished(text, m, headings)
    return F.aggregate(found, F.lit(None).cast(M.MATCH), lambda so_far, m: F.coalesce(so_far, F.when(stands(m), m)))


def stated(title: Column, description: Column) -> Column:
    """(weekend, night): quotes with what stands around them, null where nothing is stated. description keeps its lines. A null is
    empty; a weekend in the title counts alone, one in the description beside a word for work."""
    quoted = lambda text, m: F.when(m.isNotNull(), F.concat(F.lit("'"), excerpt(text, m["start"], m["end"]), F.lit("'")))
    said = lambda text, found, headings: M.let(_first(text, found, headings), lambda m: quoted(text, m))

    def read(x: Column) -> Column:
        text, title = x["text"], x["title"]
        found = F.struct(_found(text, WEEKEND).alias("weekend"), _found(text, NIGHT).alias("night"))

        def judged(f: Column, headings: Column) -> Column:
            # a title is one line, so it has no headings
            weekend = F.coalesce(said(text, f["weekend"], headings), said(title, _found(title, WEEKEND_TITLE), headings))
            return F.struct(weekend.alias("weekend"), said(text, f["night"], headings).alias("night"))

        return M.let(found, lambda f: M.let(F.when(f["weekend"].isNotNull() | f["night"].isNotNull(), education.sections(text)), lambda h: judged(f, h)))

    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    return M.let(F.struct(title.alias("title"), F.concat(title, F.lit("\n"), description).alias("text")), read)


def shift(said: Column, truncated: Column, preference: str) -> Column:
    """(status, fact, reason) of what stated() gives under a preference; null for no_preference, which rules nothing out. Any other
    name raises."""
    if not (out := RULED_OUT[preference]):
        return F.lit(None).cast("struct<status:string,fact:string,reason:string>")
    finding = lambda status, fact, reason: F.struct(F.lit(status).alias("status"), F.lit(fact).alias("fact"), reason.alias("reason"))
    blind = F.coalesce(truncated, F.lit(False)) & said["weekend"].isNull() & said["night"].isNull()
    passed = F.when(blind, finding("pass", "unassessed", F.lit("shift preference could not be assessed: the stored description is a truncated snippet")))
    passed = passed.otherwise(finding("pass", "clear", F.lit(f"no excluded shift for preference {preference}")))
    for kind, work in reversed((("weekend", "weekend work"), ("night", "night shifts"))):
        if kind in out:
            kill = finding("kill", kind, F.concat(F.lit(f"shift preference {preference} excludes {work}: "), said[kind]))
            passed = F.when(said[kind].isNotNull(), kill).otherwise(passed)
    return passed
