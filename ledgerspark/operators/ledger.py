"""Append-only ledgers: latest rows, delta replay, change-only appends and content-identity unions.

Order is a column, never the physical order of rows. Each operator is one shuffle on the key with partial
aggregation, so a key with very many rows costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Names of a delta's own parts, which no field may have.
RESERVED = ("_observation", "_remove")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by `order`: (seq) for append order, (at, seq) for time order with ties to the later append."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, *(F.col("__r")[c].alias(c) for c in rest)).select(*rows.columns)


def replay(deltas: DataFrame, key: str = "key", seq: str = "seq", full: str = "full", fields: str = "fields", removed: str = "removed") -> DataFrame:
    """(key, field, value): the state after full rows replace, updates set and removals delete.

    Only rows from a key's last full row on count; in one row a removal goes behind an update of the same field.
    A key without a full row raises, and so does a field of a reserved name.
    """
    taken = F.exists(F.map_keys(fields), lambda f: f.isin(*RESERVED))
    deltas = deltas.withColumn(fields, F.when(taken, F.raise_error(F.lit("a field of a reserved name")).cast(deltas.schema[fields].dataType)).otherwise(F.col(fields)))
    start = deltas.groupBy(key).agg(F.max(F.when(F.col(full), F.col(seq))).alias("__from"))
    start = start.withColumn("__from", F.when(F.col("__from").isNull(), F.raise_error(F.concat(F.lit("delta without a full row: "), F.col(key).cast("string"))).cast("long")).otherwise(F.col("__from")))
    live = deltas.join(start, key).where(F.col(seq) >= F.col("__from"))
    ops = F.concat(
        F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"), F.lit(0).alias("gone"))),
        F.transform(F.coalesce(removed, F.array().cast("array<string>")), lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("gone"))),
    )
    each = live.select(key, seq, F.explode(ops).alias("o")).select(key, seq, "o.*")
    last = each.groupBy(key, "field").agg(F.max_by(F.struct("value", "gone"), F.struct(seq, "gone")).alias("v"))
    return last.where("v.gone = 0").select(key, "field", F.col("v.value").alias("value"))


def deltas(rows: DataFrame, key: str, seq: str, fields: str = "fields") -> DataFrame:
    """(key, seq, full, fields, removed) of rows (key, seq, fields: map): of each row the fields that the key's row before has not
    or has otherwise, and the names it no longer has; the first row of a key is full. replay() undoes it."""
    w = Window.partitionBy(key).orderBy(seq)
    was = rows.withColumn("__was", F.lag(fields).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    changed = F.map_filter(fields, lambda k, v: F.col("__first") | ~F.coalesce(F.map_contains_key("__was", k), F.lit(False)) | ~v.eqNullSafe(F.col("__was")[k]))
    gone = F.when(F.col("__first"), F.array().cast("array<string>")).otherwise(F.sort_array(F.array_except(F.map_keys("__was"), F.map_keys(fields))))
    return was.select(key, seq, F.col("__first").alias("full"), changed.alias(fields), gone.alias("removed"))


def validated(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """rows, once all of them pass every gate; else the job stops before anything is written, and names the gate and how many fail."""
    failed = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in gates.items())).first().asDict()
    if bad := {n: k for n, k in failed.items() if k}:
        raise ValueError(f"rows fail {', '.join(f'{n} ({k})' for n, k in bad.items())}")
    return rows


def changed_only(rows: DataFrame, keys: list[str], seq: str, watched: list[str]) -> DataFrame:
    """Rows that differ from the key's row before in any watched column; the first of a key always."""
    w = Window.partitionBy(*keys).orderBy(seq)
    was = F.lag(F.struct(*watched)).over(w)
    return rows.withColumn("__was", was).where(F.col("__was").isNull() | ~F.col("__was").eqNullSafe(F.struct(*watched))).drop("__was")


def content_key(*columns: str) -> Column:
    """A digest of the columns' text, nulls told from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?")) for c in columns)), 256)


def appended(known: DataFrame, incoming: DataFrame, content: list[str]) -> DataFrame:
    """known, and one row of incoming for each content that known does not hold."""
    new = incoming.withColumn("__k", content_key(*content)).dropDuplicates(["__k"])
    return known.unionByName(new.join(known.select(content_key(*content).alias("__k")), "__k", "left_anti").drop("__k"))


def reconciled(prior: DataFrame, incoming: DataFrame, key: str = "key", complete: bool = True) -> DataFrame:
    """(key, status, action) after a snapshot: absent rows turn unknown, only if it is complete; closed stays closed."""
    both = prior.select(key, F.col("status").alias("was")).join(incoming.select(key, F.col("status").alias("now")), key, "full")
    absent = F.when(F.col("was") == "closed", "closed").when(F.lit(complete), "unknown").otherwise(F.col("was"))
    status = F.when(F.col("now").isNull(), absent).when(F.col("now") == "closed", "closed").when(F.lit(complete), "open").otherwise(F.col("now"))
    action = F.when(F.col("was").isNull(), "new").when(F.col("now").isNotNull(), "refreshed").when(status.eqNullSafe(F.col("was")), "kept").otherwise("unknown")
    return both.select(key, status.alias("status"), action.alias("action"))
