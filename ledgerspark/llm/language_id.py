"""Language ID by compression: a text is in the language whose zstandard dictionary makes it smallest.

Each language's dictionary is raw content: texts of labelled documents in hash order, of the first TEXTS of them
as many as DICT_BYTES hold. Texts go in as lower-case letters and single spaces. A text is cut into blocks of BLOCK
bytes, all of them, so that a long one doesn't become its own dictionary, and each block is compressed with each
dictionary; the sizes add up. Matches of three bytes count, or short texts would tell nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, small, stored, table

TEXTS, DICT_BYTES, BLOCK = 150, 96 << 10, 2048


def letters(text: str) -> bytes:
    return " ".join(re.sub(r"[\W\d_]+", " ", text.lower()).split()).encode()


def dictionaries(labelled: DataFrame, texts: int = TEXTS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from rows (doc_id, text, lang) of which the first `texts` of each
    language by hash of doc_id and text are taken: a bounded sample. Languages whose letters fill fewer than 8 bytes
    have none and are not learned.

    Hashes alone say which texts these are, from a share of each language's rows that holds them, and executors put a
    language's texts together; what reaches the driver is `size` bytes a language.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    hashes = stored(rows.select("lang", "h"))
    number = stored(hashes.groupBy("lang").agg(F.count("*").alias("n")))
    width, chosen = 4, None
    while chosen is None:
        # the hashes' places from 0 to 1; a language's rows below width * texts / n are some width * texts
        near = hashes.join(small(number), "lang").where((F.col("h") / 2.0**64 + 0.5) * F.col("n") <= width * texts)
        ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= texts)
        some = stored(ranked.select("lang", "h", "r", "n"))
        short = some.groupBy("lang", "n").agg(F.count("*").alias("m")).where(F.col("m") < F.least("n", F.lit(texts)))
        if number.count() == some.select("lang").distinct().count() and short.isEmpty():
            chosen = some
        else:
            drop(some)
            width *= 4

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        found = b""
        for t in g.sort_values(["r", "t"])["t"]:
            if len(found) >= size:
                break
            found += letters(t) + b"\n"
        return pd.DataFrame({"lang": g["lang"][:1], "d": [found[:size]]})

    named = chosen.select(F.col("lang").alias("l"), F.col("h").alias("k"), "r")
    # of a text, more than `size` letters never fit
    texts_ = rows.join(small(named), (F.col("lang") == F.col("l")) & (F.col("h") == F.col("k"))).select("lang", "r", F.substr("text", F.lit(1), F.lit(4 * size)).alias("t")).dropDuplicates(["lang", "r"])
    found = {r["lang"]: bytes(r["d"]) for r in texts_.groupBy("lang").applyInPandas(lambda g: joined(g), "lang string, d binary").collect()}
    drop(hashes, number, chosen)
    return {k: v for k, v in sorted(found.items()) if len(v) >= 8}


def _guess(found: dict[str, bytes], margin: float):
    names = sorted(found)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        how = z.ZstdCompressionParameters.from_level(3, strategy=z.STRATEGY_BTOPT, min_match=3, window_log=17, search_log=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders = []
        for n in names:
            d = z.ZstdCompressionDict(found[n], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            coders.append(z.ZstdCompressor(compression_params=how, dict_data=d).compress)
        for batch in batches:
            langs, scores, rejected = [], [], []
            for t in batch.column(1):
                t = t.as_py()
                if t is None or not any(map(str.isalpha, t)) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                b = letters(t)
                blocks = [b[i : i + BLOCK] for i in range(0, len(b), BLOCK)]
                sizes = [sum(len(c(x)) for x in blocks) for c in coders]
                best = min(range(len(names)), key=lambda k: (sizes[k], k))
                # each byte more makes a language half as likely, as far as bits per block can tell
                score = 1 / sum(math.exp(min(0.0, (sizes[best] - s) * 0.7)) for s in sizes)
                second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
                langs.append(names[best])
                scores.append(score)
                rejected.append(second - sizes[best] < margin * sizes[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return of_batch


def languages(docs: DataFrame, labelled: DataFrame, margin: float = 0.01) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs (doc_id, text).

    lang_pred is the language that compresses the whole text best (ties: the first by name), `und` for null texts,
    texts without a letter and where labelled has no language; score, from 0 to 1, says how much it stands out;
    rejected is true for `und` and where the second language is within margin of the best. Repeated rows are judged
    alike; an empty table gives an empty result; other columns are ignored.
    """
    found = dictionaries(labelled)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_guess(found, margin), "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each of the documents, learned from those outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # without a doc_id: not held out
    out = languages(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
