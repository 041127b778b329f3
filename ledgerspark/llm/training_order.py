"""Token-ID output in training order: every sequence gets a global slot, and shards hold slots in order.

Documents become token ids and are cut into sequences of at most LENGTH. A sequence's number, below their total N,
is its place by file, row and piece, or by doc_id, text and piece where no files are known, so that neither the
number of tasks nor how files are split changes it. A keyed Feistel permutation of the numbers below N (on the next
power of four, walking on along the cycle while it lands at N or above) turns numbers into slots: a shuffle of
everything that can be computed for one sequence alone, and undone. Slots are dealt by range to shards; each
shard is sorted and written as blocks of BLOCK records of one stride, so that the record of a slot is found by
arithmetic and reading can start at any slot.

A record is doc_id (8 bytes), piece (4), length (4) and LENGTH ids of 16 bits, little-endian, zeros behind the
last. Blocks are rows of Parquet files, which any store that Spark writes to can hold; a manifest beside them has
what a reader has to know: the total, key, stride and lengths, and the tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, scratch, stored, table
from .minhash_dedup import ODD, chunks, mix
from .tokens import coder, word_bpe

#: A shard is SHARD_BLOCKS blocks (8 MB), or more where there would be over SHARDS shards.
LENGTH, END, BLOCK, SHARD_BLOCKS, SHARDS = 1024, 1, 512, 8, 20_000
RECORD = lambda length: np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("ids", "<u2", length)])


def _keys(key: int, rounds: int = 6) -> np.ndarray:
    return mix((np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key)) * ODD)


def permuted(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The slots of numbers x below n; with back, the numbers of slots."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, keys = x.astype(np.uint64), _keys(key)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> half, x[todo] & mask
        for k in keys[::-1] if back else keys:
            a, b = (b ^ (mix(a + k) & mask), a) if back else (b, a ^ (mix(b + k) & mask))
        x[todo] = (a << half) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, place: tuple[str, str] | None = None) -> DataFrame:
    """(run, at, doc_id, piece, ids): the sequences of docs (doc_id, text). Runs in order of their names, and sequences of a run
    by `at`, are in the order of place (columns of a file and of the row in it), or else of doc_id and text."""
    tail = np.array([end], "<u2").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, last = f"{TaskContext.get().partitionId():010d}", 0, None
        for batch in batches:
            turns = [0]
            if place:
                where, row = batch.column(2).dictionary_encode(), batch.column(3).to_numpy()
                code, names = where.indices.to_numpy(), where.dictionary.to_pylist()
                turns = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(row) != 1)) + 1).tolist()]
            for a, z in zip(turns, [*turns[1:], batch.num_rows]):
                if place and (names[code[a]], row[a]) != last:  # a file's rows come in order, but perhaps not from the first on
                    run, at = f"{names[code[a]]}\0{row[a]:020d}", 0
                if place:
                    last = names[code[z - 1]], row[z - 1] + 1
                for ids, texts in chunks([batch.slice(a, z - a)]):
                    who, piece, out = [], [], []
                    codes, sizes, first = coder(tokenizer).spans(texts)
                    flat, ends = codes.astype("<u2").tobytes(), (2 * np.concatenate([[0], np.cumsum(sizes)])[first]).tolist()
                    for i, b, e in zip(ids, ends[:-1], ends[1:]):
                        x = flat[b:e] + tail
                        for p in range(0, len(x), 2 * length):
                            who.append(i)
                            piece.append(p // (2 * length))
                            out.append(x[p : p + 2 * length])
                    yield pa.RecordBatch.from_arrays([pa.array([run]).take(pa.array(np.zeros(len(who), np.int8))), pa.array(np.arange(at, at + len(who))), pa.array(who, pa.int64()), pa.array(piece, pa.int32()), pa.array(out, pa.binary())], ["run", "at", "doc_id", "piece", "ids"])
                    at += len(who)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *(F.col(c) for c in place or ()))
    if not place:
        rows = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(cut, "run string, at long, doc_id long, piece int, ids binary")


def materialise(docs: DataFrame, path: str, tokenizer: str | None = None, key: int = 20, length: int = LENGTH, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, most_shards: int = SHARDS, place: tuple[str, str] | None = None) -> int:
    """Writes docs (doc_id, text) to path in training order; returns the number of sequences.

    place names columns of docs with a row's file and its row in it, counted up, as _metadata has them; without it
    rows are first sorted by doc_id and text. The tokenizer's ids must fit 16 bits. Null and empty texts are one
    sequence that holds END alone; null doc_ids are written as -1; repeated rows are written as often as they come; an
    empty table writes an empty one; other columns are ignored. The same rows with the same settings give the same
    order on any cluster. One number for each part of a file that a task reads passes the driver.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or word_bpe()
    if coder(tokenizer).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("the tokenizer's ids do not fit 16 bits")
    cut = stored(sequences(docs, tokenizer, length, place=place))
    runs = sorted((r["run"], r["n"]) for r in cut.groupBy("run").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in runs)
    starts = dict(zip((r for r, _ in runs), (np.cumsum([0, *(n for _, n in runs)])[:-1]).tolist()))
    blocks = max(1, -(-total // block))
    per_shard = block * max(shard_blocks, -(-blocks // most_shards))
    first = spark.sparkContext.broadcast(starts)
    record = RECORD(length)

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            run = b.column(0).dictionary_encode()
            number = np.array([first.value[r] for r in run.dictionary.to_pylist()], np.int64)[run.indices.to_numpy()] + b.column(1).to_numpy()
            slot = permuted(number, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), *b.columns[2:]], ["slot", "shard", "doc_id", "piece", "ids"])

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a shard in order; a block is complete when a slot of the next one comes."""

        def done(b: int, rows: list[tuple]) -> pa.RecordBatch:
            out = np.zeros(len(rows), record)
            out["doc_id"] = [-1 if r[1] is None else r[1] for r in rows]
            out["piece"] = [r[2] for r in rows]
            out["length"] = [len(r[3]) // 2 for r in rows]
            out["ids"] = np.frombuffer(b"".join([r[3].ljust(2 * length, b"\0") for r in rows]), "<u2").reshape(-1, length)
            return pa.RecordBatch.from_arrays([pa.array([b * block // per_shard], pa.int32()), pa.array([b * block]), pa.array([len(rows)], pa.int32()), pa.array([record.itemsize], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["shard", "first_slot", "records", "stride", "payload"])

        now, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and r[0] // block != now:
                    yield done(now, rows)
                    rows = []
                now = r[0] // block
                rows.append(r)
        if rows:
            yield done(now, rows)

    dealt = cut.mapInArrow(slotted, "slot long, shard int, doc_id long, piece int, ids binary")
    dealt = dealt.repartitionById(-(-total // per_shard) or 1, F.col("shard")).sortWithinPartitions("slot").select("slot", "doc_id", "piece", "ids")
    dealt.mapInArrow(blocks_of, "shard int, first_slot long, records int, stride int, payload binary").write.option("compression", "zstd").parquet(f"{path}/shards")
    about = {"total": total, "key": key, "tokenizer": os.path.basename(tokenizer), "length": length, "block": block, "per_shard": per_shard, "stride": record.itemsize}
    spark.createDataFrame([about], "total long, key long, tokenizer string, length int, block int, per_shard long, stride int").coalesce(1).write.json(f"{path}/manifest")
    drop(cut)
    return total


def read(spark: SparkSession, path: str, first_slot: int = 0) -> DataFrame:
    """(slot, shard, doc_id, piece, length, ids as bytes) of the slots from first_slot on."""
    about = spark.read.json(f"{path}/manifest").first()
    record, block = RECORD(about["length"]), about["block"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                r = np.frombuffer(payload, record)
                slot = first + np.arange(len(r))
                r, slot = r[slot >= first_slot], slot[slot >= first_slot]
                ids = [x[:n].tobytes() for x, n in zip(r["ids"], r["length"])]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(r), shard, np.int32)), *(pa.array(np.ascontiguousarray(r[c])) for c in ("doc_id", "piece", "length")), pa.array(ids, pa.binary())], ["slot", "shard", "doc_id", "piece", "length", "ids"])

    kept = spark.read.parquet(f"{path}/shards").where(F.col("first_slot") > first_slot - block)
    return kept.select("shard", "first_slot", "payload").mapInArrow(records, "slot long, shard int, doc_id long, piece int, length int, ids binary")


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence of the documents stands in the shards, read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    materialise(docs, path := scratch(spark), place=("file", "row"))
    return read(spark, path).select("slot", "shard", "doc_id", "piece", "length", F.crc32("ids").alias("ids_crc32"))
