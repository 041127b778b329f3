"""Folds of event streams into lifecycle states and labels, in append order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_of(event: Column, states: dict[str, str]) -> Column:
    """The state an event leads to; null for events that change none."""
    out = F.lit(None).cast("string")
    for name, state in states.items():
        out = F.when(event == name, state).otherwise(out)
    return out


def fold(events: DataFrame, states: dict[str, str], key: str = "key", seq: str = "seq", event: str = "event", queued: DataFrame | None = None) -> DataFrame:
    """(key, state, seq): the state of the last event that has one. `queued` (key) is a layer below all events."""
    e = events.select(F.col(key), state_of(F.col(event), states).alias("state"), F.col(seq).alias("seq")).where("state is not null")
    if queued is not None:
        e = e.union(queued.select(key, F.lit("queued"), F.lit(None).cast("long")))
    last = e.groupBy(key).agg(F.max_by(F.struct("state", "seq"), F.coalesce("seq", F.lit(-1))).alias("l"))
    return last.select(key, "l.state", "l.seq")


def sticky_labels(events: DataFrame, lock: str, marks: dict[str, int], clear: str, key: str = "key", seq: str = "seq", event: str = "event") -> DataFrame:
    """(key, label): 1 for good once `lock` happened; else the mark of the last marking event unless `clear` came later."""
    e = F.col(event)
    mark = F.lit(None).cast("int")
    for name, value in marks.items():
        mark = F.when(e == name, value).otherwise(mark)
    counts = (e == clear) | mark.isNotNull()
    out = events.groupBy(key).agg(F.max(e == lock).alias("locked"), F.max_by(mark, F.when(counts, F.col(seq))).alias("m"))
    return out.select(key, F.when(F.col("locked"), 1).otherwise(F.col("m")).cast("int").alias("label")).where("label is not null")
