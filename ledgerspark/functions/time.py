"""Dates, instants, cohorts, pay and cost as Column expressions. What cannot be read is null and never a default."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seasons, their months and their order in a year.
SEASONS = {"spring": ((3, 4, 5), 0), "summer": ((6, 7, 8), 1), "fall": ((9, 10, 11), 2), "autumn": ((9, 10, 11), 2), "winter": ((12, 1, 2), 3)}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: How a cohort, a training position and a role's start are written.
COHORT = r"(?i)\b(spring|summer|fall|autumn|winter)\s+(20\d{2})\b"
INTERNSHIP = r"(?i)\b(?:intern(?:ship)?|co[- ]?op|cooperative education|placement)\b"
START_DAY = r"(?i)\b(?:start(?:s|ing)?|begin(?:s|ning)?)\s+(?:on\s+)?(20\d{2}-\d{2}-\d{2})\b"
START_MONTH = rf"(?i)\b(?:start(?:s|ing)?|begin(?:s|ning)?)\s+(?:in\s+)?({'|'.join(MONTHS)})\s+(20\d{{2}})\b"
#: Other words for currencies and pay periods.
CURRENCIES = {"$": "USD", "US$": "USD", "£": "GBP", "€": "EUR"}
PERIODS = {"hour": "hour", "hourly": "hour", "hr": "hour", "week": "week", "weekly": "week", "month": "month", "monthly": "month", "year": "year", "yearly": "year", "annual": "year", "annually": "year"}


def date(text: Column) -> Column:
    """The date that the first ten characters say, if they do."""
    ten = F.substr(F.btrim(text), F.lit(1), F.lit(10))
    return F.when(ten.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(ten, "yyyy-MM-dd"))


def instant(text: Column) -> Column:
    """Seconds since 1970 of an ISO instant, in UTC where it names no zone."""
    t = F.btrim(text)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([zZ]|[+-]\d{2}:?\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(F.regexp_replace(t, "[zZ]$", "+00:00"))).cast("double")


def past_instant(text: Column, now: Column) -> Column:
    """instant() of a text that names its zone and is not after now (seconds)."""
    zoned = F.btrim(text).rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    at = F.when(zoned, instant(text))
    return F.when(at <= now, at)


def first_clock(now: Column, *clocks: Column) -> Column:
    """past_instant of the first clock that says anything: one that cannot be read is not mended by a later one."""
    return past_instant(F.coalesce(*(F.nullif(c, F.lit("")) for c in clocks)), now)


def cohort(title: Column, kind: Column, description: Column) -> Column:
    """(season, year) of a training position, where both are written."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(description, F.lit("")))
    counts = said.rlike(INTERNSHIP) | F.coalesce(F.lower(kind).isin("intern", "internship", "co-op", "coop"), F.lit(False))
    return F.when(counts & said.rlike(COHORT), F.struct(F.lower(F.regexp_extract(said, COHORT, 1)).alias("season"), F.regexp_extract(said, COHORT, 2).try_cast("int").alias("year")))


def season_order(season: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (_, place) in SEASONS.items():
        out = F.when(season == name, place).otherwise(out)
    return out


def season_months(season: Column) -> Column:
    out = F.lit(None).cast("array<int>")
    for name, (months, _) in SEASONS.items():
        out = F.when(season == name, F.array(*map(F.lit, months))).otherwise(out)
    return out


def season_of(day: datetime.date) -> str:
    return next(name for name, (months, _) in SEASONS.items() if day.month in months)


def start(said: Column, *fields: Column) -> Column:
    """A role's first day: the first field that is a date, else what the text introduces as a start, a month as its first day."""
    month = F.lower(F.regexp_extract(said, START_MONTH, 1))
    number = F.array_position(F.array(*(F.lit(m.lower()) for m in MONTHS)), month).cast("int")
    year = F.regexp_extract(said, START_MONTH, 2).try_cast("int")
    return F.coalesce(*(date(f) for f in fields), date(F.regexp_extract(said, START_DAY, 1)), F.when(number > 0, F.make_date(year, number, F.lit(1))))


def number(text: Column) -> Column:
    """The first number in text, commas left out."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+(?:[.]\d+)?)", 1).try_cast("double")


def currency(text: Column) -> Column:
    raw = F.nullif(F.upper(F.btrim(text)), F.lit(""))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CURRENCIES.items() for x in kv))[raw], raw)


def period(text: Column) -> Column:
    raw = F.nullif(F.regexp_replace(F.lower(F.btrim(text)), "[ -]", "_"), F.lit(""))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))[raw], raw)


def padded(tokens: Column, to: int = 64) -> Column:
    """tokens rounded up to whole blocks."""
    return F.ceil(tokens / to) * to


def projected_cost(tokens: Column, seconds_a_token: float, startup: float, hourly: float, reserved: float) -> Column:
    """What a batch of padded tokens costs: time by throughput, start-up, and what is reserved anyway."""
    return (tokens * seconds_a_token + startup) * hourly / 3600 + reserved


def band_distance(rung: Column, lowest: int, highest: int) -> Column:
    """How many rungs a rung is outside a band."""
    return F.when(rung < lowest, lowest - rung).when(rung > highest, rung - highest).otherwise(0)
