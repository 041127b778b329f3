"""Scores and answers bound to what they were made for: exact bindings, carried scores, scoped lookups, caches, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import latest


def bound(rows: DataFrame, scores: DataFrame, key: str, binding: str, at: str, seq: str, value: str) -> DataFrame:
    """rows (key, binding) with the score of exactly that binding, else the latest by `at` of the key, marked as carried.

    Of scores of one binding the last append counts. Carried scores of one instant tie to the binding that was
    appended first the latest. Keys without a score keep nulls and are not carried.
    """
    current = scores.groupBy(key, binding).agg(F.max_by(F.struct(value, at), seq).alias("s"), F.min(seq).alias("first"))
    exact = current.select(key, binding, F.col(f"s.{value}").alias("__exact"), F.col(f"s.{at}").alias("__exact_at"), F.lit(True).alias("__hit"))
    carried = current.groupBy(key).agg(F.max_by(F.struct(binding, "s"), F.struct(f"s.{at}", "first")).alias("c"))
    carried = carried.select(key, F.col(f"c.{binding}").alias("__b"), F.col(f"c.s.{value}").alias("__carried"), F.col(f"c.s.{at}").alias("__carried_at"), F.lit(True).alias("__any"))
    hit = F.coalesce("__hit", F.lit(False))
    return rows.join(exact, [key, binding], "left").join(carried, key, "left").select(
        key, F.when(~hit & F.col("__any"), F.col("__b")).otherwise(F.col(binding)).alias(binding), F.when(hit, F.col("__exact")).otherwise(F.col("__carried")).alias(value),
        F.when(hit, F.col("__exact_at")).otherwise(F.col("__carried_at")).alias(at), (~hit & F.coalesce("__any", F.lit(False))).alias("carried"),
    )


def scoped(rows: DataFrame, answers: DataFrame, key: str, scope: str, value: str, anywhere: str) -> DataFrame:
    """rows (key, scope) with the answer for their own scope, else the one that holds anywhere, and which it was."""
    own = answers.where(F.col(scope) != anywhere).select(key, scope, F.col(value).alias("__own"))
    other = answers.where(F.col(scope) == anywhere).select(key, F.col(value).alias("__other"))
    found = F.when(F.col("__own").isNotNull(), "own").when(F.col("__other").isNotNull(), "anywhere").otherwise("none")
    return rows.join(own, [key, scope], "left").join(other, key, "left").select(key, scope, F.coalesce("__own", "__other").alias(value), found.alias("found"))


def cached(rows: DataFrame, cache: DataFrame, key: str, version: str, value: str, compute: Column) -> DataFrame:
    """rows with the cached value where key and version are equal, else computed; hit says which."""
    known = cache.select(F.col(key).alias("__k"), F.col(version).alias("__v"), F.col(value).alias("__cached"), F.lit(True).alias("__hit"))
    joined = rows.join(known, (F.col(key) == F.col("__k")) & F.col(version).eqNullSafe(F.col("__v")), "left")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.select(*rows.columns, F.when(hit, F.col("__cached")).otherwise(compute).alias(value), hit.alias("hit"))


def checked(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """rows joined to lookup; a key that lookup lacks stops the job and is named."""
    found = rows.join(lookup.withColumn("__found", F.lit(True)), key, "left")
    named = F.raise_error(F.concat(F.lit("no such key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(F.coalesce("__found", named.cast("boolean"))).drop("__found")


def health(attempts: DataFrame, key: str, at: str, seq: str, ok: Column) -> DataFrame:
    """(key, last_at, last_ok, last_success_at): the last append's outcome and the latest success, which failures keep."""
    return attempts.withColumn("__ok", ok).groupBy(key).agg(
        F.max_by(at, seq).alias("last_at"), F.max_by("__ok", seq).alias("last_ok"), F.max(F.when(F.col("__ok"), F.col(at))).alias("last_success_at")
    )


def due(attempted: Column, outcome: Column, description: Column, kind: Column, verified: Column, now: Column) -> Column:
    """Whether details are to be fetched: never within 6 hours of an attempt; else after a failure, without a full
    description, and where the last success is missing, in the future or 7 days old."""
    lately = F.coalesce((attempted <= now) & (attempted > now - F.expr("INTERVAL 6 HOURS")), F.lit(False))
    bare = (F.coalesce(description, F.lit("")) == "") | F.coalesce(kind, F.lit("missing")).isin("missing", "snippet")
    old = verified.isNull() | (verified > now) | (verified <= now - F.expr("INTERVAL 7 DAYS"))
    return ~lately & (F.coalesce(outcome.isin("unknown", "failed"), F.lit(False)) | bare | old)


def holdout(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with held_out: the last fifth of each group in order, rounded up and at least one."""
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("__j", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    return ranked.withColumn("held_out", F.col("__j") > F.col("__n") - F.greatest(F.lit(1), F.ceil(F.col("__n") / 5))).drop("__j", "__n")


def selection_hash(rows: DataFrame, group: list[str], order: list[str], **aggregates: Column) -> DataFrame:
    """The SHA-256 of each group's rows of `order`, in that order, as compact JSON lists. A group is one selection, of bounded size."""
    items = F.sort_array(F.collect_list(F.struct(*order)))
    text = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("["), F.concat_ws(",", *(x[c].cast("string") for c in order)), F.lit("]"))), ","), F.lit("]"))
    return rows.groupBy(*group).agg(*(c.alias(n) for n, c in aggregates.items()), F.sha2(text, 256).alias("selection_sha256"))
