"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenation of raw bytes.

A text of more than a chunk is cut into chunks that overlap. Each is pre-tokenised alone, in parallel, and reports
the boundaries that it finds within its two overlaps. The pattern reads from left to right and looks at nothing
before the place it stands at, so that two scans that share a boundary agree from there on: the first boundary that
both scans of an overlap have is where one chunk's pre-tokens end and the next one's begin. Neighbours without such
a place (a run of letters longer than an overlap) become one chunk, which is scanned again, until all chunks meet.
Then each chunk's pre-tokens between its two places are encoded, each by itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, stored, table

#: Characters from one chunk's start to the next one's, and by how many it goes on beyond that.
STEP, OVERLAP = 1 << 16, 1 << 11
#: A pre-token is certain if it ends so many characters before its chunk does: no pattern of contractions looks further ahead
#: than 2, and what a run of spaces, letters or marks needs to see is the one character that ends it.
MARGIN = 4
#: Pre-tokens that a worker remembers, and the longest that it does.
MOST_KNOWN, LONGEST_KNOWN = 400_000, 64

CHUNKS = "row long, doc_id long, first long, text string, heads array<long>, tails array<long>, last boolean"
PARTS = "row long, doc_id long, part long, n_parts long, ids binary"


class Coder(dict):
    """Pre-tokens and their ids, little-endian unsigned 32-bit; what is not there yet is encoded."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.whole = tiktoken.Encoding("pre-token", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def __missing__(self, token: str) -> bytes:
        ids = b"".join([i.to_bytes(4, "little") for i in self.whole.encode_ordinary(token)])
        if len(token) <= LONGEST_KNOWN:
            if len(self) >= MOST_KNOWN:
                self.clear()
            self[token] = ids
        return ids

    def encoded(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def between(self, text: str, start: int, end: int) -> bytes:
        """The ids of the pre-tokens from start on that begin before end; the text beyond is there to be looked at."""
        found = self.pattern.finditer(text, start)
        out = []
        for m in found:
            if m.start() >= end:
                break
            out.append(self[m.group()])
        return b"".join(out)

    def boundaries(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """This worker's coder."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def byte_bpe() -> tuple[str, str]:
    """The rank file's path and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that no more than one text is a Python string at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of rows, cut where size() of their rows adds up to most."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += size(r) + 64
        if held >= most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in some], schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in some], schema)


LONG, LONGS = pa.int64(), pa.list_(pa.int64())
_CUT = pa.schema([("row", LONG), ("doc_id", LONG), ("first", LONG), ("text", pa.string()), ("last", pa.bool_())])
_SCANNED = pa.schema([("row", LONG), ("doc_id", LONG), ("first", LONG), ("text", pa.string()), ("heads", LONGS), ("tails", LONGS), ("last", pa.bool_())])
_PART = pa.schema([("row", LONG), ("doc_id", LONG), ("part", LONG), ("n_parts", LONG), ("ids", pa.binary())])


def _cut(step: int, overlap: int):
    def rows(batches):
        for row, doc_id, text in _rows(batches):
            for first in range(0, len(text), step):
                last = first + step + overlap >= len(text)
                yield row, doc_id, first, text[first : first + step + overlap], last
                if last:
                    break

    return lambda batches: _batches(rows(batches), _CUT, lambda r: len(r[3]))


def _scan(names: tuple[str, str], overlap: int):
    """Pre-tokenises each chunk, given as its parts (first, text) in order, and keeps the boundaries in its overlaps."""

    def rows(batches):
        c = coder(*names)
        for row, doc_id, parts, last in _rows(batches):
            parts = sorted((p["first"], p["text"]) for p in parts)
            first, end, pieces = parts[0][0], parts[0][0], []
            for at, text in parts:
                pieces.append(text[end - at :])
                end = at + len(text)
            text = "".join(pieces)
            found = [first + b for b in c.boundaries(text)]
            tails = [] if last else [b for b in found if end - overlap <= b <= end - MARGIN]
            yield row, doc_id, first, text, [b for b in found if b <= first + overlap] if first else [], tails, last

    return lambda batches: _batches(rows(batches), _SCANNED, lambda r: len(r[3]))


def _encode_chunk(names: tuple[str, str]):
    def rows(batches):
        c = coder(*names)
        for row, doc_id, first, text, start, end, part, n_parts in _rows(batches):
            yield row, doc_id, part, n_parts, c.between(text, start - first, len(text) if end is None else end - first)

    return lambda batches: _batches(rows(batches), _PART, lambda r: len(r[4]))


def _encode_whole(names: tuple[str, str]):
    def rows(batches):
        c = coder(*names)
        for row, doc_id, text in _rows(batches):
            yield row, doc_id, 0, 1, c.encoded(text)

    return lambda batches: _batches(rows(batches), _PART, lambda r: len(r[4]))


def _met(chunks: DataFrame) -> DataFrame:
    """chunks with meets: the first boundary that a chunk and the next one both have; null where there is none."""
    w = Window.partitionBy("row").orderBy("first")
    return chunks.withColumn("meets", F.array_min(F.array_intersect("tails", F.lead("heads").over(w))))


def _chunked(long: DataFrame, names: tuple[str, str], step: int, overlap: int) -> DataFrame:
    """The chunks of long (row, doc_id, text), stored, each of which meets the next."""
    cut = long.mapInArrow(_cut(step, overlap), "row long, doc_id long, first long, text string, last boolean").repartition("row", "first")
    one = F.array(F.struct("first", "text")).alias("parts")
    chunks = stored(cut.select("row", "doc_id", one, "last").mapInArrow(_scan(names, overlap), CHUNKS))
    while True:
        # the narrow columns say who meets whom; texts move only where chunks become one
        met = stored(_met(chunks.drop("text")).select("row", "first", "meets", "last"))
        if met.where("meets is null and not last").isEmpty():
            drop(met)
            return chunks
        w = Window.partitionBy("row").orderBy("first")
        apart = F.coalesce(F.lag(F.col("meets").isNotNull()).over(w), F.lit(True)).cast("long")
        runs = met.withColumn("run", F.sum(apart).over(w)).select("row", "first", "run")
        joined = chunks.join(runs, ["row", "first"]).groupBy("row", "doc_id", "run").agg(F.collect_list(F.struct("first", "text")).alias("parts"), F.bool_or("last").alias("last"))
        new = stored(joined.select("row", "doc_id", "parts", "last").mapInArrow(_scan(names, overlap), CHUNKS))
        drop(chunks, met)
        chunks = new


def _encoded(docs: DataFrame, names: tuple[str, str], step: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The parts of texts that are one chunk, where they lie, and of longer ones."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > step + overlap
    whole = own.where(~is_long).select((-1 - F.col("row")).alias("row"), "doc_id", "text").mapInArrow(_encode_whole(names), PARTS)
    chunks = _chunked(own.where(is_long), names, step, overlap)
    w = Window.partitionBy("row").orderBy("first")
    places = _met(chunks.drop("text")).select("row", "first", F.coalesce(F.lag("meets").over(w), F.lit(0)).alias("start"), F.col("meets").alias("end"), (F.row_number().over(w) - 1).cast("long").alias("part"), F.count("*").over(Window.partitionBy("row")).alias("n_parts"))
    rest = chunks.select("row", "doc_id", "first", "text").join(places, ["row", "first"]).select("row", "doc_id", "first", "text", "start", "end", "part", "n_parts")
    return whole, rest.mapInArrow(_encode_chunk(names), PARTS)


def encoded(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, part, n_parts, ids) for docs (doc_id, text): the ids of each text in parts, little-endian unsigned 32-bit.

    A text's ids are those of its parts in order; row tells rows that repeat a doc_id, or have none, apart. A null text
    is empty and has one part without ids; special tokens' strings are ordinary text; an empty table gives no rows;
    other columns are ignored. Texts of up to step + overlap characters are one part and are not moved; of longer ones
    each chunk is a row of its own, dealt out to all tasks. A single pre-token, however long, is encoded in one task.
    """
    whole, rest = _encoded(docs, _names(ranks, pattern), *_checked(step, overlap))
    return whole.union(rest)


def _names(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    return (ranks, pattern) if ranks and pattern else (ranks or byte_bpe()[0], pattern or byte_bpe()[1])


def _checked(step: int, overlap: int) -> tuple[int, int]:
    if not MARGIN < overlap < step:
        raise ValueError(f"an overlap is more than {MARGIN} and less than a step")
    return step, overlap


def decoded(parts: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """parts (row, doc_id, part, n_parts, ids) with bytes: the raw bytes of each part's ids, which need not be whole characters."""
    names, schema = _names(ranks, pattern), _PART.append(pa.field("bytes", pa.binary()))

    def rows(batches):
        c = coder(*names)
        for r in _rows(batches):
            yield *r, c.decoded(r[4])

    return parts.select(*_PART.names).mapInArrow(lambda batches: _batches(rows(batches), schema, lambda r: 2 * len(r[4])), f"{PARTS}, bytes binary")


_DIGESTS = pa.schema([("doc_id", LONG), ("n_tokens", LONG), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text; its parts come one after another, and no more than one is held."""

    def rows():
        now = None
        for row, doc_id, ids, raw in _rows(batches):
            if now is None or now[0] != row:
                if now:
                    yield now[1], now[2], now[3].hexdigest(), now[4].hexdigest()
                now = [row, doc_id, 0, hashlib.sha256(), hashlib.sha256()]
            now[2] += len(ids) // 4
            now[3].update(ids)
            now[4].update(raw)
        if now:
            yield now[1], now[2], now[3].hexdigest(), now[4].hexdigest()

    return _batches(rows(), _DIGESTS, lambda r: 128)


def digests(docs: DataFrame, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for docs (doc_id, text), a row each: of the ids and of what they decode to."""
    whole, rest = (decoded(p) for p in _encoded(docs, byte_bpe(), *_checked(step, overlap)))
    one = whole.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
    more = rest.select("row", "part", "doc_id", "ids", "bytes").repartition("row").sortWithinPartitions("row", "part")
    return one.union(more.select("row", "doc_id", "ids", "bytes").mapInArrow(_digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document encodes, and the bytes that its ids decode to: digests of both."""
    return digests(table(spark, sf_dir, "documents"))
