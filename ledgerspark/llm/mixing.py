"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and MOST copies whose expected words meet each source's target, the ones
closest in relative entropy to one copy each are exponentially tilted by size: rate = min(MOST, exp(tilt *
size / mean size)). The tilts solve a convex dual, one unknown a source, by safeguarded Newton steps; value
and slope of all sources are one combined aggregate over the histogram of (source, size), which holds all
documents. Rates are then rounded: from the largest size down, each size of a source gets whole copies and
hands its rounding error on, and within a size the documents that get one copy more are those of the least hashes:
each size of a source has a threshold, so that copies are read off a document's source, size and hash alone, and
texts stay where they are. Copies of one document share a hash; where the threshold falls among them, their rows'
numbers decide.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, drop_since, small, stored, table, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
#: Sources at most, as one row each passes the driver and one task rounds a source's sizes; parts of the hashes.
SOURCES, PARTS = 100_000, 4096


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words each source should give: share of all words by weight, sources in code-point order with null last, none above most times its own words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _tilts(histogram: DataFrame, goal: dict[str, tuple[float, float, float]], most: float, steps: int = 200) -> dict[str, float]:
    """Each source's tilt; goal: (words, mean size, target) by key. A Newton step is one aggregate over the histogram."""
    spark = histogram.sparkSession
    tilt, low, high = {}, {}, {}
    for k, (words, mean, target) in goal.items():
        low[k], high[k] = -1e6, math.log(most) * max(mean, 1.0) + 1
        tilt[k] = high[k] if target >= most * words * (1 - 1e-12) else 0.0
    todo = {k for k, (words, _, target) in goal.items() if words and target < most * words * (1 - 1e-12)}
    rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("x")))
    for _ in range(steps):
        if not todo:
            break
        now = spark.createDataFrame([(k, tilt[k], goal[k][1]) for k in sorted(todo)], "k string, tilt double, mean double")
        at = histogram.join(now, "k").withColumn("x", F.col("size") / F.col("mean")).withColumn("w", F.col("n") * F.col("size") * rate)
        for r in at.groupBy("k").agg(F.sum("w").alias("v"), F.sum(F.when(rate < most, F.col("w") * F.col("x")).otherwise(0.0)).alias("d")).collect():
            k, gap = r["k"], r["v"] - goal[r["k"]][2]
            if abs(gap) <= 1e-9 * goal[k][2]:
                todo.discard(k)
                continue
            (high if gap > 0 else low)[k] = tilt[k]
            step = tilt[k] - gap / r["d"] if r["d"] > 0 else math.inf
            if not low[k] < step < high[k]:
                step = (low[k] + high[k]) / 2 if low[k] > -1e6 else min(2 * tilt[k], -1.0)
            tilt[k] = step
    if todo:
        raise RuntimeError(f"the tilts of {len(todo)} sources have not settled in {steps} steps")
    return tilt


def _copies(most: int):
    def of_source(h: pd.DataFrame) -> pd.DataFrame:
        """Whole copies for each size of one source, from the largest size down."""
        h = h.sort_values("size", ascending=False)
        error, out = 0.0, []
        for size, n, rate in zip(h["size"], h["n"], h["rate"]):
            words = n * size * rate + error
            c = min(max(round(words / size), 0), most * n) if size else n
            error = words - c * size
            out.append(c)
        return h.assign(copies=out)[["k", "size", "n", "rate", "copies"]]

    return of_source


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("?"))


def _cells(seen: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """(k, size, source_size, target, rate, every, last, shared, last_v), stored, of seen (doc_id, source, k, size, u, v): of a
    source and size each row gets `every` copies, and one more if its hash u is below `last`, or is `last` and, where
    that is shared, v is at most last_v."""
    mark = written()
    by_source = seen.groupBy("k", "source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(by_source) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    goal = targets({r["source"]: r["words"] for r in by_source}, weights, share, most)
    goals = {r["k"]: (float(r["words"]), max(r["words"] / r["n"], 1e-9), goal[r["source"]]) for r in by_source}
    histogram = stored(seen.groupBy("k", "size").agg(F.count("*").alias("n")))
    tilt = _tilts(histogram, goals, most)
    rows = seen.sparkSession.createDataFrame([(k, int(w), t, m, float(tilt[k])) for k, (w, m, t) in sorted(goals.items())], "k string, source_size long, target double, mean double, tilt double")
    rated = histogram.join(rows, "k").withColumn("rate", F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    cells = rated.select("k", "size", "n", "rate").groupBy("k").applyInPandas(_copies(most), "k string, size long, n long, rate double, copies long")
    cells = stored(cells.select("k", "size", "rate", F.expr("copies div n").alias("every"), (F.col("copies") % F.col("n")).alias("more")))
    # the hash of the last row that gets one more; where several rows share it and not all of them do, those of the least numbers
    last = stored(_least(seen.select("k", "size", "u"), "u", cells.where("more > 0").select("k", "size", "more")))
    ties = last.where("more < ties").select("k", "size", F.col("at").alias("u"), "more")
    tied = seen.select("k", "size", "u", "v").join(small(stored(ties.drop("more"))), ["k", "size", "u"]).drop("u")
    first = _least(tied, "v", ties.drop("u")).select("k", "size", F.col("at").alias("last_v"))
    last = last.select("k", "size", F.col("at").alias("last"), (F.col("more") < F.col("ties")).alias("shared")).join(stored(first), ["k", "size"], "left")
    out = stored(cells.drop("more").join(last, ["k", "size"], "left").join(rows.select("k", "source_size", "target"), "k"))
    drop_since(seen.sparkSession, mark, out)
    return out


def _least(rows: DataFrame, c: str, more: DataFrame) -> DataFrame:
    """(k, size, at, more, ties): the value of c that the more-th least row of (k, size) has, how many of the rows that share it
    are among the first `more`, and how many share it. Counts by leading bits say in which part it is, and counts by
    value where in that part, so that rows that share a value are one."""
    some = rows.join(small(stored(more)), ["k", "size"]).withColumn("part", _part(F.col(c)))
    left = lambda by: F.col("more") - (F.sum("m").over(Window.partitionBy("k", "size").orderBy(by)) - F.col("m"))
    parts = some.groupBy("k", "size", "more", "part").agg(F.count("*").alias("m")).withColumn("left", left("part")).where("left between 1 and m")
    few = some.drop("more").join(small(stored(parts.select("k", "size", "part", F.col("left").alias("more")))), ["k", "size", "part"])
    values = few.groupBy("k", "size", "more", c).agg(F.count("*").alias("m")).withColumn("left", left(c)).where("left between 1 and m")
    return values.select("k", "size", F.col(c).alias("at"), F.col("left").alias("more"), F.col("m").alias("ties"))


def _seen(docs: DataFrame) -> DataFrame:
    """What decides on each row: source, size, a hash of doc_id and text, and a number's hash for rows that have both alike."""
    return docs.select("doc_id", "source", _key(F.col("source")).alias("k"), word_count(F.col("text")).alias("size"), _hash().alias("u"), _number().alias("v"))


def _hash() -> Column:
    return F.xxhash64("doc_id", "text")


def _number() -> Column:
    return F.xxhash64(F.monotonically_increasing_id())


def _part(u: Column) -> Column:
    return F.shiftright(u, 64 - PARTS.bit_length() + 1)


def _copies_of(mark: str, u: Column, v: Column) -> Column:
    """How often a row is taken; a cell's columns have names that begin with mark."""
    every, last, shared, last_v = (F.col(mark + c) for c in ("every", "last", "shared", "last_v"))
    return every + F.when((u < last) | ((u == last) & (~shared | (v <= last_v))), 1).otherwise(0)


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for each row of docs (doc_id, text, source).

    Sizes are words; null, empty and blank texts have size 0, take no words and get one copy. Reruns agree, as only
    source, size and a hash of doc_id and text decide; of rows that have all of these alike, and are the same but for their
    other columns, as many are taken as the plan says. An empty table
    gives an empty result. Sources are at most SOURCES: one row each passes the driver, as their weights do.
    """
    seen = stored(_seen(docs))
    cells = _cells(seen, weights, share, most)
    out = seen.join(small(cells), ["k", "size"]).withColumn("copies", _copies_of("", F.col("u"), F.col("v")))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs, all columns, each row as often as mixture() says. Texts are not moved: copies are read off each row."""
    seen = stored(_seen(docs))
    cells = _cells(seen, weights, share, most)
    drop(seen)
    plan = small(cells.select(*(F.col(c).alias(f"__{c}") for c in ("k", "size", "every", "last", "shared", "last_v"))))
    rows = docs.withColumns({"__of": _key(F.col("source")), "__words": word_count(F.col("text")), "__u": _hash(), "__v": _number()})
    rows = rows.join(plan, (F.col("__of") == F.col("__k")) & (F.col("__words") == F.col("__size")))
    return rows.withColumn("__i", F.explode(F.array_repeat(F.lit(0), _copies_of("__", F.col("__u"), F.col("__v")).cast("int")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each of the documents the mix takes."""
    return mixture(table(spark, sf_dir, "documents")).drop("source")
