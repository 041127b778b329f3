"""Questions of forms, phrases and links as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import label

#: Which questions are reserved for a person, as patterns over label(), in the order they are tried.
SIGN_IN = r"\b(password|passcode|verification code|one time code|otp)\b"
CONSENT = r"\b(consent|attest\w*|certif\w*|acknowledg\w*|privacy|terms and conditions|agree to|i agree|signature)\b"
EEO = r"\b(gender|race|ethnic|hispanic|latino|veteran|disability|disabled|self identif\w*|demographic|sexual orientation|pronouns)\b"
SPONSORSHIP = r"\b(sponsorship|visa support|immigration support|work visa)\b"
AUTHORIZATION = r"\b(authori[sz]ed to work|authori[sz]ation to work|eligible to work|legal right to work|lawful right to work|work permit|right to work)\b"
#: Numbers in words.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")


def reserved(asked: Column, kind: Column) -> Column:
    """The reason for which a question is left to a person; null for all others."""
    t = label(asked)
    sponsored = t.rlike(SPONSORSHIP) & ~(F.contains(t, F.lit("research")) | F.contains(t, F.lit("colleague")))
    may_work = t.rlike(AUTHORIZATION)
    return (
        F.when((kind == "password") | t.rlike(SIGN_IN), "sign_in").when(kind == "file", "file").when(t.rlike(CONSENT), "consent").when(t.rlike(EEO), "eeo")
        .when(sponsored & (may_work | (F.contains(t, F.lit("without")) & F.contains(t, F.lit("work")))), "authorization_sponsorship").when(sponsored, "sponsorship").when(may_work, "authorization")
    )


def question_key(asked: Column, company: Column) -> Column:
    """label() of a question with the company's name, or its first word, as {company}."""
    out, name = F.concat(F.lit(" "), label(asked), F.lit(" ")), label(F.coalesce(company, F.lit("")))
    for part in (name, F.substring_index(name, " ", 1)):
        out = F.when(part != "", F.replace(out, F.concat(F.lit(" "), part, F.lit(" ")), F.lit(" {company} "))).otherwise(out)
    return F.btrim(out)


def number(word: Column) -> Column:
    """An integer of digits or a number word."""
    place = F.array_position(F.array(*map(F.lit, NUMBERS)), F.lower(word))
    return F.coalesce(word.try_cast("int"), F.when(place > 0, (place - 1).cast("int")))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether text holds the words of phrase, whatever the case and spaces, not as part of a longer word, C++ or C#."""
    body = r"\s+".join(map(re.escape, phrase.split()))
    return text.rlike(rf"(?i)(?<![A-Za-z0-9+#]){body}(?![A-Za-z0-9+#])")


def matcher(text: Column, terms: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Whether text holds any of the terms as whole words, or matches any of the patterns, whatever the case."""
    every = [rf"(?<![\p{{L}}\p{{N}}_]){re.escape(t)}(?![\p{{L}}\p{{N}}_])" for t in terms] + [f"(?:{p})" for p in patterns]
    return text.rlike("(?i)" + "|".join(every)) if every else F.lit(False)


def variants(words: Column, longest: int = 4) -> Column:
    """The runs of 2 to `longest` words of an array, longer ones first, each once, joined by spaces."""
    empty = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(empty)

    return F.array_distinct(F.concat(*(runs(n) for n in range(longest, 1, -1))))


def contact_link(route: Column) -> Column:
    """A mail or web address as a link; null for anything else, and for addresses with a user's name."""
    r = F.btrim(route)
    mail = F.regexp_replace(r, "^mailto:", "")
    return F.when(mail.rlike(r"^[^\s@<>?]+@[^\s@<>?]+\.[^\s@<>?]+$"), F.concat(F.lit("mailto:"), mail)).when(r.rlike(r"^https?://[^\s/@?#:]+(:\d+)?([/?#]\S*)?$"), r)


def rung(title: Column, rungs: list[tuple[str, str]], band: tuple[int, int]) -> Column:
    """The rung (from 0) that a title names: of several, the one nearest the band, and of equally near ones the lower."""
    from .time import band_distance

    named = [F.when(title.rlike(f"(?i){p}"), F.struct(band_distance(F.lit(i), *band).alias("d"), F.lit(i).alias("i"))) for i, (_, p) in enumerate(rungs)]
    return F.least(*named)["i"] if len(named) > 1 else named[0]["i"]
