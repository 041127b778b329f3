"""Month intervals, segments, running budgets, batches and holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month(date: Column) -> Column:
    """year * 12 + month - 1."""
    return F.year(date) * 12 + F.month(date) - 1


def guaranteed(start: Column, end: Column) -> Column:
    """Whole months strictly inside."""
    return F.greatest(end - start - 1, F.lit(0))


def occupied_months(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, months): distinct months that the key's intervals touch, both ends included.

    Of each interval, in order of start, what lies behind the ends of those before it counts, so that no month is a row.
    """
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.where(F.col(start) <= F.col(end)).withColumn("__new", F.col(end) - F.greatest(F.col(start), F.max(end).over(w) + 1) + 1)
    return each.groupBy(*keys).agg(F.sum(F.greatest("__new", F.lit(0)).cast("long")).alias("months"))


def segments(active: DataFrame, keys: list[str], month: str = "month", members: str = "members") -> DataFrame:
    """Maximal runs of consecutive months with the same members: (keys, first, last, members)."""
    w = Window.partitionBy(*keys).orderBy(month)
    cut = (F.lag(month).over(w) != F.col(month) - 1) | ~F.lag(members).over(w).eqNullSafe(F.col(members))
    marked = active.withColumn("__s", F.sum(F.coalesce(cut, F.lit(True)).cast("int")).over(w))
    return marked.groupBy(*keys, "__s").agg(F.min(month).alias("first"), F.max(month).alias("last"), F.min(members).alias("members")).drop("__s")


def running_total(rows: DataFrame, partition: str, order: str, cost: Column, descending: bool = False, steps: int = 64) -> DataFrame:
    """rows with spent, the cost up to and with each row in its partition's order; order is a number, unique in it.

    A partition's rows are parted at `steps` quantiles of order; each part is summed, and a row's total is that of the
    parts before and of the rows before it in its part, so that a partition with very many rows is many tasks. Only the
    cuts are doubles: numbers that one double stands for are in one part, and in it rows go by the number itself.
    """
    own = F.col(order).desc() if descending else F.col(order).asc()
    at = rows.withColumn("__at", F.col(order).cast("double") * (-1 if descending else 1)).withColumn("__cost", cost)
    cuts = at.groupBy(partition).agg(F.percentile_approx("__at", [i / steps for i in range(1, steps)], 1000).alias("__cuts"))
    at = at.join(cuts.withColumnRenamed(partition, "__p"), F.col(partition).eqNullSafe(F.col("__p")))
    at = at.withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("__at")))).drop("__cuts", "__p")
    before = Window.partitionBy(partition).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(partition, "__part").agg(F.sum("__cost").alias("s")).withColumn("__before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    parts = parts.select(F.col(partition).alias("__p"), F.col("__part").alias("__q"), "__before")
    w = Window.partitionBy(partition, "__part").orderBy(own).rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("__own", F.sum("__cost").over(w)).join(parts, F.col(partition).eqNullSafe(F.col("__p")) & (F.col("__part") == F.col("__q")))
    return out.withColumn("spent", F.col("__before") + F.col("__own")).select(*rows.columns, "spent")


def interleaved(rows: DataFrame, board: str, order: str) -> DataFrame:
    """rows with turn: the n-th of each board comes before any board's n+1-th."""
    return running_total(rows, board, order, F.lit(1).cast("long")).withColumnRenamed("spent", "turn")


def batches(rows: DataFrame, partition: str, order: str, size: int = 500, descending: bool = True) -> DataFrame:
    """rows with batch, numbered from 0: size rows each, in the partition's order."""
    out = running_total(rows, partition, order, F.lit(1).cast("long"), descending)
    return out.withColumn("batch", F.expr(f"(spent - 1) div {size}")).drop("spent")
