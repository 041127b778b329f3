"""The documents' way to packed sequences: quality rules, near-dedup, secret scans, mixing, packing.

Each stage gets what the one before kept. run() writes each stage's rows to the shared folder, reads them again, and
deletes the rows of the stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import drop_since, maybe_in, stored, table, written
from ledgerspark.llm.minhash_dedup import near_duplicates
from ledgerspark.llm.mixing import mixed
from ledgerspark.llm.packing import packed
from ledgerspark.llm.quality_rules import quality_rules
from ledgerspark.llm.secret_scan import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, out="__quality").where("__quality.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id; of rows that repeat a doc_id, one of
    the smallest text. Rows without a doc_id stay, as no class can name them.

    Texts that are certainly kept are not moved: rows go through the exact join only if a bitmap of the doc_ids that
    have to go, or that repeat, may hold theirs.
    """
    classes = near_duplicates(docs.where("doc_id is not null"))
    counts = classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("kept").alias("kept"))
    drops = stored(counts.where("n > 1 or not kept").select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept")))
    rows = maybe_in(docs, "doc_id", drops.select("__id"), "__maybe")
    sure = rows.where("not __maybe").select(*docs.columns)
    rest = rows.where("__maybe").drop("__maybe").join(drops, F.col("doc_id") == F.col("__id"), "left").where("coalesce(__kept, true)")
    order = F.struct(F.coalesce("text", F.lit("")), *(F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")))
    rest = rest.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return sure.union(rest.select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packed(docs)


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_dedup), ("secret scans", secrets), ("mixing sources", mix), ("best-fit packing", pack)]

#: Covariance estimates, sketches and token ids have no SQL; tests hold each stage against plain versions of what it does, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        drop_since(spark, mark, docs)  # the stage before, and what this one needed
    return docs
