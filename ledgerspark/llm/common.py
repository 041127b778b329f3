"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.sources.scratch import folder as scratch

#: Rows up to which a narrow table is broadcast (some 40 bytes a row), and the words of 64 bits of a bitmap.
MOST_BROADCAST, BITMAP = 1 << 20, 1 << 18

#: The characters that part words, and the patterns of words and of the gaps between them.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of stored() that are still there, in order.
_folders: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, lost executors cost nothing, and joins know its size."""
    df.write.parquet(path := scratch(df.sparkSession))
    _folders.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._folder)


def written() -> int:
    """How many stored tables there are now, for drop_since()."""
    return len(_folders)


def drop_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Deletes the tables stored since written() was mark, but for kept ones."""
    for path in _folders[mark:]:
        if path not in {t._folder for t in kept}:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _folders.remove(path)


def small(df: DataFrame) -> DataFrame:
    """A stored narrow table, marked for broadcast if its rows are few enough; else joins shuffle."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def summed(parts: DataFrame, keys: list[str], fan: int = 16) -> DataFrame:
    """Of parts (keys, p, m: doubles as bytes; p: the number of a task), the sums of m by keys and a p below fan.

    Sums go level by level, so that no task adds more than some fan of them up, and few reach the driver.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name in keys)

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(g["m"].iloc[0]).copy()
        for m in g["m"].iloc[1:]:
            total += np.frombuffer(m)
        return g[[*keys, "p"]].iloc[:1].assign(m=[total.tobytes()])

    parts = stored(parts)
    most = (parts.agg(F.max("p")).first()[0] or 0) + 1
    while most > fan:
        most = -(-most // fan)
        parts = parts.withColumn("p", (F.col("p") % most).cast("int")).groupBy(*keys, "p").applyInPandas(lambda g: add(g), f"{kinds}{', ' if keys else ''}p int, m binary")
    return parts


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """rows with flag: false where key is certainly not among ids (one column, of long), by a bitmap of BITMAP words.

    The bitmap is at most BITMAP rows, however many ids there are, so it is broadcast; wide rows that an exact join
    need not see stay where they are. With very many ids all flags are true and nothing is lost but the saving.
    """
    place = lambda c: (F.xxhash64(c).bitwiseAND(F.lit(BITMAP - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(c), 58).cast("int")))
    word, bit = place(F.col(ids.columns[0]))
    bits = stored(ids.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    word, bit = place(F.col(key))
    found = rows.join(F.broadcast(bits), word == F.col("__word"), "left")
    return found.withColumn(flag, F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)) & F.col(key).isNotNull()).drop("__word", "__bits")


def let(value: Column, body) -> Column:
    """body(value) as a Column, with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null, empty and blank texts."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    """The number of words: each leaves one mark, and the rest goes."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marked, GAP, "")).cast("long")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for each node of edges (a, b), stored: root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars, which takes about as many rounds as
    the logarithm of the longest chain; beyond most_rounds it raises. The smallest neighbour is a combined aggregate
    and the joins are plain shuffled joins on stored tables, whose hot keys adaptive execution splits, so that one
    node with very many edges needs no task of its own.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        # done when every larger end has one smaller one, which is no larger end itself
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            break
        both = e.union(e.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, both.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        small_ = large.join(low, large.a == low.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        next_ = stored(small_.union(low.select("u", "m")).distinct())
        drop(e, least, large, low)
        e = next_
    else:
        raise RuntimeError(f"the components have not settled in {most_rounds} rounds")
    out = stored(e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    drop(e)
    return out
