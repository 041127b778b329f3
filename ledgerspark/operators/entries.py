"""The list of entries: status ladder, presentation groups, filters, order, pages and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The words a status can be, in the order they are reported, and the states that progress an application.
STATUSES = ("applied", "queued", "needs-review", "unscored", "hard-killed", "closed", "not-filtered", "no-text", "too-long", "protected")
PROGRESS = ("approved", "rejected", "prepared", "filled", "submitted", "concluded", "withdrawn")
STATES = ("queued", "approved", "prepared", "filled", "submitted", "concluded", "rejected", "withdrawn")
QUEUED, HIDDEN = 0.5, 0.1
#: Marks at the edges of a title that its presentation group leaves out.
TITLE_EDGE = " -–—,.;:/\\|·•*&_+()[]{}'\""


def status(state: Column, verdict: Column, listing: Column, probability: Column, scored: Column) -> Column:
    """The first rung that holds. Only an entry that passed its filters stands by its score."""
    passed = verdict == "pass"
    return (
        F.when(state.isin(*PROGRESS), "applied").when(verdict == "kill", "hard-killed").when(listing == "closed", "closed")
        .when(passed & (probability >= QUEUED), "queued").when(passed & (probability < HIDDEN), "hard-killed")
        .when(passed & probability.isNotNull(), "needs-review").when(passed & scored, "unscored").otherwise("not-filtered")
    )


def is_new(at: Column, previous: Column, last: Column) -> Column:
    """After the fetch before the last one, if there is one, and not after the last; false where a clock is missing."""
    return F.coalesce((at <= last) & (previous.isNull() | (at > previous)), F.lit(False))


def fetch_window(fetches: DataFrame, at: str = "at") -> DataFrame:
    """One row (previous, last): the two latest instants; previous is null where there is only one."""
    top = fetches.select(at).where(F.col(at).isNotNull()).orderBy(F.desc(at)).limit(2)
    return top.agg(F.min(at).alias("previous"), F.max(at).alias("last"), F.count("*").alias("n")).select(F.when(F.col("n") > 1, F.col("previous")).alias("previous"), "last")


def grouped(entries: DataFrame, group: Column, order: list[Column]) -> DataFrame:
    """entries with group_id, rank, group_size and group_is_new (from is_new)."""
    e = entries.withColumn("group_id", group)
    w = Window.partitionBy("group_id")
    return e.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("group_size", F.count("*").over(w)).withColumn("group_is_new", F.max("is_new").over(w))


def title_group(company: Column, title: Column, location: Column, key: Column) -> Column:
    """One company's equal titles at one place are one group; a blank part makes the entry its own."""
    blank = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" ")) == ""
    parts = F.lower(F.btrim(company, F.lit(" "))), F.lower(F.btrim(title, F.lit(TITLE_EDGE))), F.lower(F.btrim(location, F.lit(" ")))
    return F.when(blank(company) | blank(title) | blank(location), key.cast("string")).otherwise(F.concat_ws("\x1f", *parts))


#: The orders a page can have; keys make each unique.
ORDERS = {
    "verified": [("verified", False), ("discovered", False)],
    "discovered": [("discovered", False)],
    "title": [("title", True), ("board", True)],
}
#: Statuses whose pages go by score first.
SCORED = ("queued", "needs-review")
#: The columns that a search looks through.
SEARCHED = ("title", "company", "board", "location", "key", "reason", "summary")


@dataclass(frozen=True)
class Page:
    """A request for the list. Only what is given filters; bounds are checked."""

    status: str | None = None
    application: str | None = None
    rule: str | None = None
    search: str | None = None
    places: tuple[str, ...] = ()
    sort: str = "verified"
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 1000 or self.offset < 0:
            raise ValueError("limit is 1 to 1000 and offset 0 or more")
        if self.status is not None and self.status not in STATUSES:
            raise ValueError(f"no such status: {self.status}")
        if self.application not in (None, "saved", "dismissed", "active"):
            raise ValueError(f"no such application: {self.application}")
        if self.sort not in ORDERS:
            raise ValueError(f"no such order: {self.sort}")


#: The home lists as requests.
PRESETS = {
    "queued": Page(status="queued"), "needs-review": Page(status="needs-review"), "filtered": Page(status="hard-killed"), "unscored": Page(status="unscored"),
    "applied": Page(status="applied", application="active"), "saved": Page(application="saved"), "dismissed": Page(application="dismissed"),
}


def home_list(status: Column, state: Column) -> Column:
    """The home list that an entry belongs to."""
    applied = F.when(state == "approved", "saved").when(state == "rejected", "dismissed").otherwise("applied")
    return F.when(status == "applied", applied).when(status.isin("unscored", "needs-review", "queued"), status).otherwise("filtered")


def contains(term: str, *columns: Column) -> Column:
    """term as a literal part of any column, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(term.lower())), F.lit(False))
    return found


def asked(entries: DataFrame, request: Page) -> DataFrame:
    """The entries that a request asks for: status, application state, the rule that killed, a search, and any of some places, for
    which entries have an array of that name."""
    out = entries
    if request.status:
        out = out.where(F.col("status") == request.status)
    if request.application:
        state = F.col("state")
        active = (F.col("status") == "applied") & ~state.isin("approved", "rejected")
        out = out.where({"saved": state == "approved", "dismissed": state == "rejected", "active": active}[request.application])
    if request.rule:
        out = out.where((F.col("verdict") == "kill") & (F.col("rule") == request.rule))
    if request.places:
        out = out.where(F.coalesce(F.arrays_overlap("places", F.array(*map(F.lit, request.places))), F.lit(False)))
    if request.search and request.search.strip():
        out = out.where(contains(request.search.strip(), *(F.col(c) for c in SEARCHED if c in out.columns)))
    return out


def page(heads: DataFrame, entries: DataFrame, request: Page, key: str = "key") -> DataFrame:
    """The entries of a request's page of heads, with position, in order.

    Keys alone are sorted and cut; the page's wide rows, limit at most, are then looked up among the entries.
    """
    by = [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in ORDERS[request.sort]]
    if request.status in SCORED:
        by = [F.desc_nulls_last("probability"), *by]
    by = [*by, F.asc(key)]
    more = [c for c in ("group_size", "group_is_new") if c in heads.columns]
    columns = dict.fromkeys([key, *more, "probability", *(c for c, _ in ORDERS[request.sort])])
    keys = heads.orderBy(*by).offset(request.offset).limit(request.limit).select(*(c for c in columns if c in heads.columns))
    keys = keys.withColumn("position", F.row_number().over(Window.orderBy(*by))).select(F.col(key).alias("__key"), "position", *more)
    return entries.join(F.broadcast(keys), F.col(key) == F.col("__key")).drop("__key").orderBy("position")


def funnel(entries: DataFrame) -> DataFrame:
    """One row of counts: all, by status, and of saved and dismissed ones; 0 where there is none."""
    counts = {"discovered": F.lit(True)} | {s.replace("-", "_"): F.col("status") == s for s in STATUSES} | {"saved": F.col("state") == "approved", "dismissed": F.col("state") == "rejected"}
    return entries.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
