"""Work authorisation: restrictions that a text states, denies or only prefers, by what stands around each match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions import matches as M
from ledgerspark.functions.text import excerpt

#: Wording of preferences, of requirements and of denials, and how far before a match the first and the last are read.
PREFERENCE = r"(?iU)\b(?:preferred|ideally|bonus|nice to have|a plus)\b"
REQUIREMENT = (
    r"(?iU)\b(?:required|requires?|requirements?|qualifications?|must|minimum|completed|completion|earned|possess(?:es)?|hold(?:s)?|"
    r"you have|about you|your background|education and experience|candidate has|candidate will have)\b"
)
DENIAL = r"(?iU)\b(?:no|not|non|without|isn't|isn’t|aren't|aren’t)\b"
PREFERENCE_REACH, DENIAL_REACH = 70, 30


@dataclass(frozen=True)
class Authorization:
    """Patterns that disqualify, in the order they are read, and patterns that are passed on purpose."""

    restrictions: tuple[str, ...] = ()
    noted: tuple[str, ...] = ()
    noted_label: str = "noted"
    clear: str = "no explicit restriction"


def preferred(text: Column, start: Column, reach: int = PREFERENCE_REACH) -> Column:
    """Whether what stands at start is a wish: a preference is near before it, or the last one before it is followed by no requirement."""
    head = M.before(text, start)
    return M.before(text, start, reach).rlike(PREFERENCE) | (head.rlike(PREFERENCE) & ~M.last_piece(head, PREFERENCE).rlike(REQUIREMENT))


def denied(text: Column, start: Column, quote: Column, reach: int = DENIAL_REACH) -> Column:
    """Whether a match is denied, shortly before it or within."""
    return M.before(text, start, reach).rlike(DENIAL) | quote.rlike(DENIAL)


def work_authorization(text: Column, truncated: Column, policy: Authorization) -> Column:
    """(status, fact, reason) of a text in one line. A restriction that is stated kills, with what stands around it. Else the
    text passes, and fact says how: noted, denied (which is stronger than preferred), preferred, unassessed where the
    text is truncated, or clear. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(f"array<{M.MATCH}>")
    found = [F.transform(M.matches(text, p), lambda m: F.struct(m.alias("m"), F.when(preferred(text, m["start"]), "preferred").when(denied(text, m["start"], m["quote"]), "denied").otherwise("kill").alias("how"))) for p in policy.restrictions]
    found = F.concat(*found) if found else F.array().cast(f"array<struct<m:{M.MATCH},how:string>>")
    noted = F.concat(*(F.slice(M.matches(text, p), F.lit(1), F.lit(1)) for p in policy.noted)) if policy.noted else none
    quoted = lambda m: F.concat(F.lit("'"), excerpt(text, m["start"], m["end"]), F.lit("'"))
    said = lambda status, fact, reason: F.struct(F.lit(status).alias("status"), (fact if isinstance(fact, Column) else F.lit(fact)).alias("fact"), reason.alias("reason"))

    def judged(x: Column) -> Column:
        kills, has = F.filter(x["found"], lambda f: f["how"] == "kill"), lambda how: F.exists(x["found"], lambda f: f["how"] == how)
        waived = F.when(has("denied"), "denied").when(has("preferred"), "preferred")
        blind = F.coalesce(truncated, F.lit(False))
        reason = F.when(blind, "work authorization could not be assessed: the stored description is a truncated snippet").otherwise(policy.clear)
        return (
            F.when(F.size(kills) > 0, said("kill", "restricted", F.concat(F.lit("work-authorization restriction: "), quoted(F.get(kills, F.lit(0))["m"]))))
            .when(F.size(x["noted"]) > 0, said("pass", "noted", F.concat(F.lit(f"passed deliberately — {policy.noted_label}: "), quoted(F.get(x["noted"], F.lit(0))))))
            .otherwise(said("pass", F.coalesce(waived, F.when(blind, "unassessed").otherwise("clear")), reason))
        )

    return F.transform(F.array(F.struct(found.alias("found"), noted.alias("noted"))), judged)[0]
