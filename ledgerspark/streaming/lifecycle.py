"""The lifecycle fold over a stream: the same states as the batch fold, whatever order rows come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.lifecycle import state_of


def fold_stream(events: DataFrame, states: dict[str, str], key: str = "key", seq: str = "seq", event: str = "event") -> DataFrame:
    """(key, state, seq) of a streaming DataFrame, for output modes update and complete. One row of state a key: the
    event with the greatest seq wins, so no watermark is needed."""
    e = events.select(F.col(key), state_of(F.col(event), states).alias("state"), F.col(seq).alias("seq")).where("state is not null")
    return e.groupBy(key).agg(F.max_by(F.struct("state", "seq"), "seq").alias("l")).select(key, "l.state", "l.seq")


def run_once(folded: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a fold_stream until it has read what is there. Changed keys of each batch are written to path, a folder a
    batch, so that a batch that runs again replaces its own rows; current() has the last state of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    folded.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def current(folded: DataFrame, key: str) -> DataFrame:
    """The last state of each key among the rows that run_once has written."""
    return folded.groupBy(key).agg(F.max_by(F.struct("state", "seq"), "seq").alias("l")).select(key, "l.state", "l.seq")
