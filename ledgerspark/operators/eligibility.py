"""Rules that pass, kill or stay unknown, each with a reason's short name: employer, pay, and timing; and how they combine.

A finding is a struct (status, fact) of Columns. What is not stated is unknown, and unknown never kills.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions import time as T


def finding(status: str, fact: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(fact).alias("fact"))


def first_of(*cases: tuple[Column, str, str], otherwise: tuple[str, str]) -> Column:
    """The finding of the first case whose condition holds."""
    out = finding(*otherwise)
    for holds, status, fact in reversed(cases):
        out = F.when(F.coalesce(holds, F.lit(False)), finding(status, fact)).otherwise(out)
    return out


def employer_excluded(excluded: list[str], *names: Column) -> Column:
    """Whether a board, company or resolved name is an excluded employer, whatever the case."""
    return F.coalesce(F.greatest(*(F.coalesce(F.lower(F.btrim(n)).isin(*(e.lower() for e in excluded)), F.lit(False)) for n in names)), F.lit(False))


def pay(minimum: Column, maximum: Column, currency: Column, period: Column, floor: float | None, in_currency: str | None, per: str | None) -> Column:
    """Stated pay against a floor; ceilings kill, and only in the floor's own currency and period."""
    if floor is None:
        return finding("pass", "salary_none")
    if in_currency is None or per is None:
        return first_of((minimum.isNull() & maximum.isNull(), "unknown", "salary_unknown"), otherwise=("unknown", "salary_unknown"))
    said, often = T.currency(currency), T.period(period)
    return first_of(
        (minimum.isNull() & maximum.isNull(), "unknown", "salary_unknown"),
        (said.isNull(), "unknown", "currency_unknown"),
        (said != T.CURRENCIES.get(in_currency, in_currency.upper()), "unknown", "salary_currency"),
        (often.isNull(), "unknown", "period_unknown"),
        (often != T.PERIODS.get(per, per), "unknown", "salary_period"),
        (maximum.isNull() & (minimum < floor), "unknown", "salary_unknown"),
        (maximum < floor, "kill", "salary_below_floor"),
        otherwise=("pass", "salary_clear"),
    )


@dataclass(frozen=True)
class Timing:
    """What a profile asks of a role's time."""

    reference: datetime.date
    years: tuple[int, ...] = ()
    seasons: tuple[str, ...] = ()
    months: tuple[int, ...] = ()
    available_from: datetime.date | None = None
    available_until: datetime.date | None = None

    @property
    def configured(self) -> bool:
        return bool(self.years or self.seasons or self.months or self.available_from or self.available_until)


def window(cohort: Column, start: Column, t: Timing) -> Column:
    """A cohort (season, year) and a first day against what is asked."""
    season, year = cohort["season"], cohort["year"]
    order, now = T.season_order(season), T.SEASONS[T.season_of(t.reference)][1]
    asked = F.lit(bool(t.years or t.seasons or t.months))
    of_seasons = sorted({m for s in t.seasons for m in T.SEASONS[s][0]})
    bounded = F.lit(t.available_from is not None or t.available_until is not None)
    cases = [((year < t.reference.year) | ((year == t.reference.year) & (order < now)), "kill", "past_cohort")]
    if t.years:
        cases.append((~year.isin(*t.years), "kill", "year_mismatch"))
    if t.seasons:
        cases.append((~season.isin(*t.seasons), "kill", "season_mismatch"))
    cases.append((asked & cohort.isNull() & start.isNull(), "unknown", "timing_unknown"))
    if t.seasons:
        cases.append((~F.month(start).isin(*of_seasons), "kill", "season_mismatch"))
    if t.years:
        cases.append((~F.year(start).isin(*t.years), "kill", "year_mismatch"))
    if t.months:
        cases.append((~F.month(start).isin(*t.months), "kill", "month_mismatch"))
        cases.append((~F.arrays_overlap(T.season_months(season), F.array(*map(F.lit, t.months))), "kill", "month_mismatch"))
    cases.append((bounded & start.isNull(), "unknown", "timing_unknown"))
    if t.available_from:
        cases.append((start < F.lit(t.available_from), "kill", "before_available"))
    if t.available_until:
        cases.append((start > F.lit(t.available_until), "kill", "after_available"))
    return first_of(*cases, otherwise=("pass", "timing_clear"))


def timing(deadline: Column, cohort: Column, start: Column, t: Timing) -> Column:
    """A deadline that has passed kills; then the window; without any statement there is nothing to assess."""
    w = window(cohort, start, t)
    stated = deadline.isNotNull() | cohort.isNotNull() | start.isNotNull() | F.lit(t.configured)
    return F.when(F.coalesce(deadline < F.lit(t.reference), F.lit(False)), finding("kill", "expired")).otherwise(F.when(w["status"] != "pass", w).otherwise(F.when(stated, w).otherwise(finding("pass", "timing_none"))))


def combined(time: Column, money: Column, floor: float | None) -> Column:
    """An explicit kill outranks what is unknown, and that a pass."""
    of = lambda status: F.when(time["status"] == status, time).when(money["status"] == status, money)
    return F.coalesce(of("kill"), of("unknown"), money if floor is not None else time)


def relevant(deadline: Column, published: Column, paid: Column, cohort: Column, t: Timing, floor: float | None) -> Column:
    """Whether a row says anything on time or pay, or the profile asks."""
    return F.lit(floor is not None or t.configured) | deadline.isNotNull() | published.isNotNull() | paid | cohort.isNotNull()


def passed_reason(rules: list[str], blind: list[str], truncated: Column) -> Column:
    """What a pass says: the rules in order, and those that had no text to read."""
    named = lambda r: " and ".join(x.replace("_", " ") for x in r) if len(r) < 3 else f"{', '.join(x.replace('_', ' ') for x in r[:-1])}, and {r[-1].replace('_', ' ')}"
    base = f"passed {named(rules)} hard filters"
    return F.when(truncated & F.lit(bool(blind)), f"{base}, but {named(blind)} could not be assessed: the stored description is a truncated snippet").otherwise(base)
