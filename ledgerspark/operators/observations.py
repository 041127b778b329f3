"""Merging an observation of a source into the row that is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_facts(before: Column, now: Column) -> Column:
    """Facts (maps) of now over those of before; all of before where now says nothing."""
    kept = F.map_filter(before, lambda k, v: ~F.map_contains_key(now, k))
    return F.when(now.isNull() | (F.size(now) == 0), before).when(before.isNull(), now).otherwise(F.map_concat(kept, now))


def said(now: Column, before: Column) -> Column:
    """now, unless it is null or empty."""
    return F.coalesce(F.nullif(now, F.lit("")), before)


def merged(known: DataFrame, seen: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows (key, title, description, kind, facts, first_seen, listing, last_verified, last_attempt) after an observation
    at `at` of seen (key, title, description, kind, facts, listing); rows that were not seen stay.

    A full description outlives excerpts, the first sight never changes, and only a trusted state of the listing moves
    the clock of its verification; an unknown one moves that of attempts.
    """
    b, n = (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"n.{c}"))
    both = known.alias("b").join(seen.alias("n"), F.col(f"b.{key}") == F.col(f"n.{key}"), "full")
    here, was = n(key).isNotNull(), b(key).isNotNull()
    keep = (b("kind") == "full") & ((F.coalesce(n("description"), F.lit("")) == "") | F.coalesce(n("kind"), F.lit("missing")).isin("missing", "snippet"))
    keep = was & F.coalesce(keep, F.lit(False))
    text = F.when(keep, b("description")).otherwise(said(n("description"), b("description")))
    own = F.when(n("kind").isin("missing", "snippet"), F.coalesce(b("kind"), n("kind"))).otherwise(F.coalesce(n("kind"), b("kind")))
    kind = F.when(keep, "full").otherwise(F.coalesce(own, F.when(F.coalesce(text, F.lit("")) != "", "full").otherwise("missing")))
    listing = F.when(here, F.coalesce(n("listing"), F.lit("unknown"))).otherwise(b("listing"))
    sure = here & (listing != "unknown")
    return both.select(
        F.coalesce(n(key), b(key)).alias(key), said(n("title"), b("title")).alias("title"), text.alias("description"), kind.alias("kind"), merged_facts(b("facts"), n("facts")).alias("facts"),
        F.coalesce(b("first_seen"), at).alias("first_seen"), listing.alias("listing"), F.when(sure, at).otherwise(b("last_verified")).alias("last_verified"), F.when(here & ~sure, at).otherwise(b("last_attempt")).alias("last_attempt"),
    )
