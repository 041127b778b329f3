"""Best-fit packing: a configuration linear program over the length histogram.

Documents become token ids, only those over CAPACITY are cut, and the pieces' histogram of lengths, at most
CAPACITY numbers, is all the plan needs. Pieces over CAPACITY / SMALL tokens are planned by the program: fewest
sequences whose patterns of lengths cover the histogram. Lengths are the longest of at most KINDS runs of
about as many pieces. It is solved by multiplicative weights: a length's price falls exponentially with how much of
it is covered, a knapsack dynamic program finds the pattern of the highest price, no length more often than it occurs,
and the pattern is used so often that no length's cover grows by more than STEP; once all is covered twice, what the
second time needed is scaled down to cover just once, and cut, the least used first, as far as all stay covered. Equal
patterns are one. Patterns are rounded down to whole sequences within the histogram,
then once each, the most used first, as long as the histogram has their pieces, and the program is solved again for
what is left, until nothing is. All other pieces, and the smallest piece of each sequence where that saves sequences,
go by best fit, longest first, into the room that this leaves and then into new sequences. Where that makes more
sequences than best fit alone would, the least full of the program's sequences are taken apart again, until it does not. The plan works on counts of equal pieces and equal sequences throughout, so its size does not follow the input's. Each
piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .minhash_dedup import chunks
from .tokens import coder, word_bpe

#: CHUNK bytes of text at a time and WORDS remembered words keep a worker near 160 MB.
CAPACITY, END, CHUNK, WORDS = 4096, 1, 1 << 18, 350_000
SMALL, KINDS, STEP = 16, 128, 0.25


def best_pattern(kinds: list[int], value: list[float], most: list[int], capacity: int) -> tuple[dict[int, int], float]:
    """Of kinds (lengths), the pattern {index: how often} of at most capacity in all that is worth most, none more often
    than `most` says, and its worth. Repeats go in powers of two, each of which is in the pattern or not."""
    best, rows = np.zeros(capacity + 1), []
    for i, k in enumerate(kinds):
        rest, a = min(most[i], capacity // k), 1
        while rest:
            a = min(a, rest)
            new = best[: capacity + 1 - a * k] + a * value[i]
            better = new > best[a * k :]
            rows.append((i, a, better))
            np.copyto(best[a * k :], new, where=better)
            rest -= a
            a *= 2
    out: dict[int, int] = {}
    c = capacity
    for i, a, better in reversed(rows):
        if c >= a * kinds[i] and better[c - a * kinds[i]]:
            out[i] = out.get(i, 0) + a
            c -= a * kinds[i]
    return out, float(best[capacity])


def fractional(kinds: np.ndarray, number: np.ndarray, capacity: int) -> tuple[list[tuple[float, dict[int, int]]], float]:
    """Patterns {index of kind: how often} and how often each is used to hold each kind (a length) as often as number says; and
    sequences that any such plan needs at least, by the best prices met."""
    if not len(kinds):
        return [], 0.0
    lengths, most, covered = kinds.tolist(), number.tolist(), np.zeros(len(kinds))
    used: dict[tuple, float] = defaultdict(float)
    bound, sharpness, start = 0.0, math.log(max(len(kinds), 2)) / STEP, None
    while (low := covered.min()) < 2:
        if start is None and low >= 1:  # prices have found their level: what was used until now is dropped
            start = covered.copy()
            used.clear()
        value = kinds / capacity * np.exp(-sharpness * (covered - low))
        pattern, worth = best_pattern(lengths, value.tolist(), most, capacity)
        bound = max(bound, float((value * number).sum()) / worth)
        times = STEP * min(most[i] / a for i, a in pattern.items())
        for i, a in pattern.items():
            covered[i] += a * times / most[i]
        used[tuple(sorted(pattern.items(), reverse=True))] += times
    low = (covered - start).min()
    spare = ((covered - start) / low - 1) * number
    out = []
    for pattern, times in sorted(used.items(), key=lambda x: x[1]):
        less = min(times / low, *(spare[i] / a for i, a in pattern))
        for i, a in pattern:
            spare[i] -= a * less
        if times / low > less:
            out.append((times / low - less, dict(pattern)))
    return out, bound


def _kinds(counts: np.ndarray) -> list[list[list[int]]]:
    """The lengths that counts has, [length, how many] from short to long, in at most KINDS runs of about as many pieces."""
    lengths = np.flatnonzero(counts)
    if len(lengths) <= KINDS:
        return [[[int(k), int(counts[k])]] for k in lengths]
    middle = np.cumsum(counts[lengths]) - counts[lengths] / 2
    run = (middle * KINDS / counts.sum()).astype(int)
    return [[[int(k), int(counts[k])] for k in lengths[run == r]] for r in np.unique(run)]


def patterned(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, their lengths with repeats) of all pieces over the SMALL-th part of a sequence, by the program."""
    capacity = len(counts) - 1
    planned = counts.astype(np.int64).copy()
    planned[: capacity // SMALL + 1] = planned[capacity] = 0
    groups: list[tuple[int, dict[int, int]]] = []

    def take(times: int, pattern: dict[int, int]) -> None:
        """As few groups as the runs of equal lengths allow, the longest pieces of each kind first."""
        while times:
            items: dict[int, int] = defaultdict(int)
            for i, a in pattern.items():
                for k, n in reversed(pools[i]):
                    items[k] += (n := min(a, n))
                    if not (a := a - n):
                        break
            same = min(times, *(n // items[k] for i in pattern for k, n in pools[i] if k in items))
            for i in pattern:
                for run in pools[i]:
                    run[1] -= items.get(run[0], 0) * same
                while pools[i] and not pools[i][-1][1]:
                    pools[i].pop()
            groups.append((same, dict(items)))
            times -= same

    while planned.any():
        pools = _kinds(planned)
        left = np.array([sum(n for _, n in p) for p in pools])
        patterns, _ = fractional(np.array([p[-1][0] for p in pools]), left, capacity)
        patterns.sort(key=lambda x: -x[0])
        for least in (0, 1):  # rounded down, and then once each
            for times, pattern in patterns:
                times = min(max(int(times + 1e-9), least), *(int(left[i] // a) for i, a in pattern.items()))
                if times > 0:
                    take(times, pattern)
                    for i, a in pattern.items():
                        left[i] -= a * times
        planned[:] = 0
        for k, n in (run for p in pools for run in p):
            planned[k] = n
    return groups


def _without_last(groups: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """The groups without the smallest piece of each sequence, whose place best fit may fill better."""
    return [(times, {k: a - (k == min(items)) for k, a in items.items() if a > (k == min(items))} if sum(items.values()) > 1 else items) for times, items in groups]


#: Shares of the program's sequences that are kept, fullest first, until the rest needs no more than best fit alone does.
KEPT = (1.0, 0.99, 0.97, 0.95, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2, 0.1)


def _fullest(groups: list[tuple[int, dict[int, int]]], share: float) -> list[tuple[int, dict[int, int]]]:
    """The fullest sequences of groups, about share of all."""
    left, out = math.ceil(share * sum(times for times, _ in groups)), []
    for times, items in sorted(groups, key=lambda g: -sum(k * a for k, a in g[1].items())):
        if left:
            out.append((min(times, left), items))
            left -= out[-1][0]
    return out


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, their lengths with repeats); together they hold each length as often as counts says.

    As many of the program's sequences stay, with or without their smallest pieces, as leave the whole with no more
    sequences than best fit alone would make.
    """
    groups, number = patterned(counts), lambda p: sum(times for times, _ in p)
    alone = filled(counts, [])
    for share in KEPT:
        kept = _fullest(groups, share)
        best = min((filled(counts, g) for g in (kept, _without_last(kept))), key=number)
        if number(best) <= number(alone):
            return best
    return alone


def filled(counts: np.ndarray, used: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """The sequences used, and all pieces that they do not hold by best fit, longest first."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}
    spaces: list[int] = []

    def add(space: int, times: int, items: dict[int, int]) -> None:
        if space not in groups:
            bisect.insort(spaces, space)
            groups[space] = []
        groups[space].append((times, items))

    full = [(int(left[capacity]), {capacity: 1})] if left[capacity] else []
    left[capacity] = 0
    for times, items in used:
        for k, a in items.items():
            left[k] -= a * times
        add(capacity - sum(k * a for k, a in items.items()), times, items)
    for k in range(capacity - 1, 0, -1):
        while left[k] > 0:
            at = bisect.bisect_left(spaces, k)
            if at == len(spaces):
                a = min(capacity // k, int(left[k]))
                times = int(left[k]) // a
                add(capacity - a * k, times, {k: a})
                left[k] -= a * times
                continue
            space = spaces[at]
            times, items = groups[space].pop()
            if not groups[space]:
                del groups[space]
                spaces.pop(at)
            if times > left[k]:
                add(space, times - int(left[k]), items)
                times = int(left[k])
            left[k] -= times
            add(space - k, times, items | {k: items.get(k, 0) + 1})
    return full + [g for space in spaces for g in groups[space]]


def _places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces of that length in a sequence, first sequence, offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for times, items in patterns:
        offset = 0
        for k, a in sorted(items.items(), reverse=True):
            rows.append((k, rank.get(k, 0), a, first, offset))
            rank[k] = rank.get(k, 0) + a * times
            offset += a * k
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text): ids of the whole text, then `end`."""
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, CHUNK):
            rows = []
            for i, b in zip(ids, coder(tokenizer, WORDS).encode(texts)):
                b += tail
                rows += [(i, p // (4 * capacity), p // 4, min(capacity, (len(b) - p) // 4), zlib.crc32(b[p : p + 4 * capacity])) for p in range(0, len(b), 4 * capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of docs (doc_id, text), each with its sequence_id and offset.

    Null and empty texts are one piece that holds `end` alone. Repeated rows are packed as often as they come;
    an empty table gives an empty result; other columns are ignored.
    """
    cut = stored(pieces(docs, tokenizer or word_bpe(), capacity, end))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    salts = max(64, int(counts.sum()) // 100_000)
    spark = docs.sparkSession
    places = spark.sparkContext.broadcast(_places(plan(counts)))

    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("m")).select("length", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before")))
    ranked = salted.withColumn("j", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(parts, ["length", "salt"]).select(*cut.columns, (F.col("before") + F.col("j") - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = places.value
        key = (p[:, 0] << 48) + p[:, 1]
        for b in batches:
            row = p[np.searchsorted(key, (b["length"].to_numpy() << 48) + b["rank"].to_numpy(), "right") - 1]
            j = b["rank"].to_numpy() - row[:, 1]
            yield b.drop(columns="rank").assign(sequence_id=row[:, 3] + j // row[:, 2], offset=row[:, 4] + j % row[:, 2] * row[:, 0])

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece of the documents."""
    return packed(table(spark, sf_dir, "documents"))
