"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets.

A sketch has SLOTS places. In round i every shingle of a document is hashed to one place and a value, and a
place keeps the least (round, value), the round in 10 bits; after SLOTS rounds of random places, round SLOTS + j puts every shingle
in place j, so each place is filled, and two sketches agree in a place with the probability of their sets'
similarity, concentrated as for independent places. Documents whose sketches agree in all places of a band
are candidates. With 32 bands of 4 places, a pair of similarity 0.75 is missed with probability 6e-6.

Exact copies are one class from the start. In each bucket of a band every member is held against the first
one. Where that leaves a bucket in several parts, the members outside its largest part are compared in tiles
with all others of the buckets that have this largest part: tile against tile by longer sketches of one byte a
place, first for the likeliest partners of each member, then, for members that are still apart, for all that
the sketches do not rule out (FINE_SLOTS places and 4 standard deviations). Every link is confirmed on the full
sets, and a family of near copies is never paired in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop, drop_since, maybe_in, stored, table, written

SLOTS, BANDS, WIDTH, PERCENT = 128, 32, 5, 75
FINE_SLOTS, TILE = 512, 256
FINE_LEAST = PERCENT / 100 - 4 * (PERCENT / 100 * (1 - PERCENT / 100) / FINE_SLOTS) ** 0.5
CHUNK = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: For each byte: whether it parts words, and a random odd number, the same for an ASCII letter's two cases.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of BASE and of its inverse, as many as the longest chunk so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)])) for x in (BASE, INVERSE))


def located_words(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, ASCII letters in either case alike; each text's first word and the end;
    the joined texts and where in them each word starts and ends."""
    joined = b" ".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    space = np.concatenate([[True], IS_SPACE[data]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turn[::2], turn[1::2]
    powers.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers.up[: len(data)])])
    hashed = mix((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))
    return hashed, np.searchsorted(starts, bounds), joined, starts, ends


def hashed_words(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and each text's first word and the end."""
    return located_words(texts, powers)[:2]


def shingles(texts: list[bytes], powers: Powers, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles; of all words, if it has fewer."""
    hashed, first = hashed_words(texts, powers)
    n = len(hashed) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        rolled = (rolled + hashed[k : k + n]) * ODD + np.uint64(k + 1)
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for x in hashed[a:b]:
                h = mix((h + x) * ODD)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` values for each set; empty sets have none filled."""
    sizes = np.array([len(s) for s in sets])
    table_ = np.full(len(sets) * slots, NONE)
    items, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * slots):
        if not len(items):
            break
        h = mix(items + np.uint64((i + 1) * int(ODD) & int(NONE)))
        place = (h & np.uint64(slots - 1)).astype(np.int64) if i < slots else np.int64(i - slots)
        np.minimum.at(table_, owner * slots + place, (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10)))
        if i % 2 or i < 4:
            open_ = (table_.reshape(len(sets), slots) == NONE).any(axis=1)
            keep = open_[owner]
            items, owner = items[keep], owner[keep]
    return table_.reshape(len(sets), slots)


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as bytes; null: empty), about `most` bytes at a time."""
    for batch in batches:
        ids, texts, size, all_ids = [], [], 0, batch.column(0).to_pylist()
        column = batch.column(1)
        for k, i in enumerate(all_ids):
            t = column[k].as_buffer() if column[k].is_valid else None
            t = t.to_pybytes() if t is not None else b""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def longs(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD)
    for ids, texts in chunks(batches):
        sets = shingles(texts, powers)
        sketch = sketches(sets).reshape(len(sets), BANDS, SLOTS // BANDS)
        bands = np.broadcast_to(seeds, (len(sets), BANDS))
        for k in range(SLOTS // BANDS):
            bands = mix((bands + sketch[:, :, k]) * ODD)
        keys = _keys(sets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), longs([b if len(s) else s for s, b in zip(sets, bands)])],
            ["doc_id", "n", "k1", "k2", "bands"],
        )


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit keys of each set, which name it."""
    return np.array([[(mix(s * x) if len(s) else s).sum(dtype=np.uint64) for x in (ODD, BASE)] for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for ids, texts in chunks(batches):
        sets = shingles(texts, powers)
        fine = [x.tobytes() for x in mix(sketches(sets, FINE_SLOTS)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_keys(sets)[:, 0].copy()), longs(sets), pa.array(fine, pa.binary())], ["doc_id", "k1", "s", "fine"])


def _likely(best: int):
    """Pairs of two tiles' members that differ in root, at least one of them outside its family's main part, whose
    sketches allow a link; for each such member the `best` likeliest only, unless 0."""

    def of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0), batch.column(1)):
                (ax, nx, rx, mx, fx), (ay, ny, ry, my, fy) = (_members(t.values) for t in (x, y))
                take = np.flatnonzero(mx)
                size = np.minimum(nx[take, None], ny) * 100 >= PERCENT * np.maximum(nx[take, None], ny)
                ok = size & (rx[take, None] != ry)
                ok &= ~my | (ax[take, None] < ay)  # a pair of outside members comes in both orders
                i, j = np.nonzero(ok)
                like = np.concatenate([(fx[take[i[k : k + 4096]]] == fy[j[k : k + 4096]]).mean(axis=1) for k in range(0, len(i), 4096)] or [np.zeros(0)])
                like = (like - 1 / 256) / (1 - 1 / 256)
                keep = like >= FINE_LEAST
                i, j, like = i[keep], j[keep], like[keep]
                if best:
                    order = np.lexsort((-like, i))
                    i, j = i[order], j[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < best
                    i, j = i[keep], j[keep]
                i = take[i]
                swap = ax[i] > ay[j]
                pair = [np.where(swap, ay[j], ax[i]), np.where(swap, ny[j], nx[i]), np.where(swap, ax[i], ay[j]), np.where(swap, nx[i], ny[j])]
                out.append(np.array(pair).T)
            out = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], ["a", "na", "b", "nb"])

    return of_tiles


def _members(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
    ids, n, root, outside = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("node", "n", "root", "outside"))
    fine = np.frombuffer(b"".join(rows.field("fine").to_pylist()), np.uint8).reshape(-1, FINE_SLOTS)
    return ids, n, root, outside, fine


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Linked are documents with 100 * shared shingles >= PERCENT * shingles of either. Null, empty and blank
    texts have no shingles and are linked with nothing; texts of fewer than WIDTH words are linked with equal
    ones only. component_id is the smallest doc_id reachable. Rows that repeat a doc_id come back as often; they
    are one document, in one class, whose links are those of all its texts. Null doc_ids link with nothing.
    doc_ids are below 2^62. An empty table gives an empty result; other columns are ignored.
    """
    mark = written()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    seen = stored(rows.mapInArrow(_features, "doc_id long, n long, k1 long, k2 long, bands array<long>"))
    alone = stored(seen.where("n = 0 or doc_id is null").select("doc_id", "n"))
    able = seen.where("n > 0 and doc_id is not null")
    heads = stored(able.groupBy("k1", "k2", "n").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("h")).select("k1", "k2", "n", "h.doc_id", "h.bands"))
    # a set's node is the smallest doc_id that has it; where one doc_id is so for several sets, the others get numbers beyond doc_ids
    first = heads.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n")).alias("f"), F.count("*").alias("sets")).where("sets > 1")
    first = stored(first.select(F.col("doc_id").alias("d"), "f"))
    beyond = F.shiftrightunsigned(F.xxhash64("k1", "k2", "n"), 2).bitwiseOR(F.lit(1 << 62))
    named = heads.join(first, F.col("doc_id") == F.col("d"), "left")
    named = stored(named.withColumn("node", F.when(F.col("f").isNull() | (F.col("f") == F.struct("k1", "k2", "n")), F.col("doc_id")).otherwise(beyond)).drop("d", "f"))
    of = stored(able.select("doc_id", "k1", "k2", "n").join(named.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).select("doc_id", "n", "node"))
    same = of.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("doc_id")
    same = stored(same.union(alone.where("doc_id is not null").select("doc_id")).distinct())
    same = stored(of.join(same, "doc_id").where("doc_id <> node").select("node", F.col("doc_id").alias("root")).distinct())

    keys = named.select(F.explode("bands").alias("key"), "node", "n")
    shared = stored(keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("m")).where("m > 1"))
    keys = stored(keys.join(shared, "key").select("key", "node", "n", "m", "c"))
    wanted = keys.select("node").distinct().join(named.select("node", "doc_id", "k1"), "node")
    wanted = stored(wanted.select("node", F.col("doc_id").alias("d"), F.col("k1").alias("k")))
    texts = maybe_in(rows, "doc_id", wanted.select("d"), "__maybe").where("__maybe").select("doc_id", "t")
    texts = texts.join(wanted.select(F.col("d").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "t"])
    sets = texts.mapInArrow(_sets, "doc_id long, k1 long, s array<long>, fine binary")
    sets = stored(sets.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("k1") == F.col("k"))).select("node", "s", "fine"))
    drop(seen, heads, named, first, shared, wanted)

    pairs = keys.where("node <> c.node").select(F.col("c.node").alias("a"), F.col("c.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    checked, root = _linked(pairs, sets, None, same)
    parts = stored(keys.where("m > 2").select("key", "node", "n"))
    drop(keys)
    for best in (2, 0):
        tiles = _tiles(parts, root, sets)
        likely = _tile_pairs(tiles).mapInArrow(_likely(best), "a long, na long, b long, nb long")
        checked, more = _linked(likely, sets, checked, root)
        drop(tiles)
        root = more
    drop_since(docs.sparkSession, mark, alone, of, root)

    every = of.union(alone.select("doc_id", "n", "doc_id"))
    out = every.join(root.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _tiles(parts: DataFrame, root: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of buckets in several parts, by family (the root of a bucket's largest part) and step (members of
    steps that are not the same or next ones differ too much in size to be linked), in tiles of about TILE."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / PERCENT)) + 1e-9)
    parts = parts.join(root.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    parts = stored(parts.select("key", "node", "n", F.coalesce("root", "node").alias("root"), step.alias("step")))
    main = parts.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("family"), F.count("*").alias("parts")).where("parts > 1")
    main = stored(main.select("key", "family"))
    family = stored(parts.join(main, "key").select("family", "step", "node", "n", "root").distinct())
    counts = stored(family.groupBy("family", "step").agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    member = F.struct("node", "n", "root", (F.col("root") != F.col("family")).alias("outside"), "fine")
    tiled = family.join(counts, ["family", "step"]).join(sets.select("node", "fine"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    out = stored(tiled.groupBy("family", "step", "tile").agg(F.collect_list(member).alias("rows"), F.max(F.col("root") != F.col("family")).alias("some")))
    drop(parts, main, family, counts)
    return out


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """(rowsx, rowsy): each tile that has outside members with every tile of its family in the same or a next step.
    Pairs are made of the tiles' names, and the rows fetched by them, so that a large family is many tasks."""
    names = tiles.select("family", "step", "tile", "some")
    x = names.where("some").select("family", F.col("step").alias("stepx"), F.col("tile").alias("tilex"))
    y = names.select("family", F.col("step").alias("stepy"), F.col("tile").alias("tiley"))
    pairs = stored(x.join(y, "family").where("abs(stepx - stepy) <= 1"))
    side = lambda s: tiles.select("family", F.col("step").alias(f"step{s}"), F.col("tile").alias(f"tile{s}"), F.col("rows").alias(f"rows{s}"))
    return pairs.join(side("x"), ["family", "stepx", "tilex"]).join(side("y"), ["family", "stepy", "tiley"]).select("rowsx", "rowsy")


def _linked(pairs: DataFrame, sets: DataFrame, checked: DataFrame | None, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs checked, and each node's root, with those of pairs (a, na, b, nb) that share enough added to what root links."""
    pairs = pairs.where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").distinct()
    if checked is not None:
        pairs = pairs.join(checked, ["a", "b"], "left_anti")
    pairs = stored(pairs)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    links = stored(both.where(f"100 * i >= {PERCENT} * (na + nb - i)").select("a", "b"))
    seen = pairs.select("a", "b") if checked is None else checked.union(pairs.select("a", "b"))
    if checked is not None and links.isEmpty():
        return seen, root
    # what is linked already counts as one edge to its root
    return seen, components(links.union(root.where("node <> root").select("node", "root")))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each of the documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
