"""Embedding near-dedup: PCA-ordered tiled comparison.

Unit vectors are turned to the principal axes of all vectors of their dimension (one combined aggregate of
second moments), so that the leading dimensions hold most of a product. Two vectors with cosine >= c are at
most sqrt(2 - 2 c) apart, hence also along the first AXES axes: a grid of that width over them puts a vector's
partners in its own cell or a neighbouring one. Cells are dealt in tiles of about TILE vectors; pairs of tiles are
made of their names, and the vectors fetched by them, so that a cell that holds much is many tasks. Within a pair of tiles products are accumulated over blocks of leading dimensions;
what is left of a product is at most the product of the two suffix norms, and a pair is dropped as soon as this
bound keeps its cosine below the threshold. Pairs that remain are confirmed by the cosine of the vectors as given.

A pair of tiles returns, for each vector, its number of links and the smallest vec_id that links within the two
tiles join it to, so that no pairs are sent anywhere. Equal vectors are one vector from the start.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop_since, stored, summed, table, written

THRESHOLD, TILE, BLOCK, AXES = 0.98, 512, 8, 3


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second moments of a partition's unit vectors by dimension, as bytes."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for d, g in b.groupby("d"):
            x = np.stack(g["v"].to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[d] = sums.get(d, 0) + x.T @ x
    yield pd.DataFrame({"d": list(sums), "m": [m.tobytes() for m in sums.values()]})


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by dimension, the longest first. What reaches the driver is 16 d x d matrices a dimension at most."""
    parts = vectors.select("d", "v").mapInPandas(_moments, "d int, m binary").withColumn("p", F.spark_partition_id())
    sums: dict[int, np.ndarray] = {}
    for r in summed(parts, ["d"]).collect():
        sums[r["d"]] = sums.get(r["d"], 0) + np.frombuffer(r["m"])
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in sums.items()}


def _turned(axes: dict[int, np.ndarray], width: float):
    def of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds the turned unit vector's cell; the vector itself stays as given."""
        for b in batches:
            cells = np.zeros((len(b), AXES), np.int64)
            for d, at in b.groupby("d").indices.items():
                x = np.stack(b["v"].to_numpy()[at]).astype(float)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                cells[at, : min(AXES, d)] = np.floor(x @ axes[d][:, :AXES] / width)
            yield b.assign(**{f"c{i}": cells[:, i] for i in range(AXES)})

    return of_batch


def linked(u: np.ndarray, w: np.ndarray, axes: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with cosine(u[i], w[j]) >= threshold."""
    nu, nw = np.linalg.norm(u, axis=1), np.linalg.norm(w, axis=1)
    a, b = (u / nu[:, None]) @ axes, (w / nw[:, None]) @ axes
    rest = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0.0))
    ra, rb = rest(a), rest(b)
    d, low = a.shape[1], threshold - 1e-9
    p = a[:, :BLOCK] @ b[:, :BLOCK].T
    i, j = np.nonzero(p + (np.outer(ra[:, BLOCK], rb[:, BLOCK]) if d > BLOCK else 0.0) >= low)
    p = p[i, j]
    for k in range(BLOCK, d, BLOCK):
        p = p + np.einsum("ij,ij->i", a[i, k : k + BLOCK], b[j, k : k + BLOCK])
        ok = p + (ra[i, k + BLOCK] * rb[j, k + BLOCK] if k + BLOCK < d else 0.0) >= low
        i, j, p = i[ok], j[ok], p[ok]
    exact = np.einsum("ij,ij->i", u[i], w[j]) / (nu[i] * nw[j]) >= threshold
    return i[exact], j[exact]


def _compared(axes: dict[int, np.ndarray], threshold: float):
    def of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, same, xs, ys in zip(*(batch.column(i) for i in range(4))):
                (ix, mx, x), (iy, my, y) = (_tile(t.values, d.as_py()) for t in (xs, ys))
                i, j = linked(x, y, axes[d.as_py()], threshold)
                if same.as_py():
                    i, j = (v[i < j] for v in (i, j))
                if not len(i):
                    continue
                ids = np.concatenate([ix, iy])
                a, b = i, j if same.as_py() else j + len(ix)
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, a, my[j])
                np.add.at(links, b, mx[i])
                root = ids.copy()
                while True:
                    was = root.copy()
                    least = np.minimum(root[a], root[b])
                    np.minimum.at(root, a, least)
                    np.minimum.at(root, b, least)
                    if (root == was).all():
                        break
                hit = np.flatnonzero(links)
                out.append(np.stack([ids[hit], links[hit], root[hit]], axis=1))
            out = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], ["node", "links", "root"])

    return of_pairs


def _tile(rows: pa.StructArray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(float)
    return rows.field("node").to_numpy(), rows.field("copies").to_numpy(), values.reshape(-1, d)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Compared are vectors of equal, non-null label and equal dimension. Null and zero vectors, empty ones, those
    with null or non-finite components and rows without a vec_id link with nothing. n_links counts rows; rows that repeat
    a vec_id are vectors of their own, with links of their own, that share a class. vec_ids are below 2^62. An empty
    table gives an empty result; other columns are ignored.
    """
    mark, width = written(), math.sqrt(2 - 2 * threshold)
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(fine, F.col("embedding")).alias("v"))
    good = rows.where("v is not null").withColumn("k", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))
    heads = stored(good.groupBy("label", "k").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.any_value("v").alias("v")).withColumn("d", F.size("v")))
    # a vector's node is the smallest vec_id that has it; where one is so for several vectors, the others get numbers beyond vec_ids
    first = heads.groupBy("vec_id").agg(F.min(F.struct("label", "k")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select(F.col("vec_id").alias("i"), "f"))
    beyond = F.shiftrightunsigned(F.xxhash64("label", "k"), 2).bitwiseOR(F.lit(1 << 62))
    node = F.when(F.col("f").isNull() | (F.col("f") == F.struct("label", "k")), F.col("vec_id")).otherwise(beyond)
    nodes = stored(heads.join(first, F.col("vec_id") == F.col("i"), "left").select(node.alias("node"), "label", "k", "copies", "v", "d"))
    member = stored(good.select("vec_id", "label", "k").join(nodes.select("label", "k", "node", "copies"), ["label", "k"]).select("vec_id", "node", "copies"))
    same = member.groupBy("vec_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("vec_id")
    same = member.join(stored(same), "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b")).distinct()

    axes = _axes(nodes)
    at = [f"c{i}" for i in range(AXES)]
    cells = stored(nodes.select("node", "label", "copies", "v", "d").mapInPandas(_turned(axes, width), f"node long, label string, copies long, v array<double>, d int, {', '.join(f'{c} long' for c in at)}"))
    counts = stored(cells.groupBy("label", "d", *at).agg(F.ceil(F.count("*") / TILE).alias("tiles")))
    tiled = cells.join(counts, ["label", "d", *at]).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    name = ["label", "d", *at, "tile"]
    tiles = stored(tiled.groupBy(*name).agg(F.collect_list(F.struct("node", "copies", "v")).alias("rows")))
    # each pair of neighbouring cells once: from the cell to itself and to half of its neighbours
    half = [s for s in itertools.product((-1, 0, 1), repeat=AXES) if s >= (0,) * AXES]
    steps = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(at, s))) for s in half))
    left = tiles.select(*name).withColumn("s", F.explode(steps))
    own = F.col("s") == F.struct(*(F.lit(0).alias(c) for c in at))
    left = left.select("label", "d", *((F.col(c) + F.col("s")[c]).alias(c) for c in at), own.alias("own"), *(F.col(c).alias(f"{c}_") for c in at), F.col("tile").alias("tile_"))
    pairs = stored(left.join(tiles.select(*name), ["label", "d", *at]).where("not own or tile_ <= tile").withColumn("same", F.col("own") & (F.col("tile") == F.col("tile_"))).drop("own"))
    there = tiles.select("label", "d", *(F.col(c).alias(f"{c}_") for c in (*at, "tile")), F.col("rows").alias("rows_"))
    fetched = pairs.join(there, ["label", "d", *(f"{c}_" for c in (*at, "tile"))]).join(tiles, name)
    found = stored(fetched.select("d", "same", "rows_", "rows").mapInArrow(_compared(axes, threshold), "node long, links long, root long"))
    links = stored(found.groupBy("node").agg(F.sum("links").alias("links")))
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(same))
    of = stored(member.join(links, "node", "left").select("vec_id", "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    drop_since(vectors.sparkSession, mark, of, root)
    done = of.join(root.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("vec_id", "n_links", F.coalesce("root", "node").alias("component_id"))
    done = done.union(rows.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and the class of each of the embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a
), c AS (SELECT n AS vec_id, min(m) AS component_id FROM r GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
