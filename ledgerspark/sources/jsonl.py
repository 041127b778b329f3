"""JSON Lines ledgers: every line has its place (file, line), which is the append order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, and the columns of schema) of the *.jsonl files below path; blank lines are left out.

    A line that is not an object of this schema raises with its file and line. Files are parts of bounded size, so
    each is read whole and lines are numbered in place.
    """
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    lines = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    rows = lines.where(F.btrim("text") != "").withColumn("r", F.from_json("text", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    where = F.concat("file", F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(": not a row of the ledger"))
    rows = rows.withColumn("r", F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.raise_error(where).cast(rows.schema["r"].dataType)).otherwise(F.col("r")))
    return rows.select("file", (F.col("line") + 1).alias("line"), "r.*").drop("_bad")


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read(), or no rows where there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return read(spark, path, schema)
    return spark.createDataFrame([], f"file string, line int, {schema}")


def append(rows: DataFrame, path: str, day: str, most_rows: int = 1_000_000) -> None:
    """Adds rows as JSON Lines, a folder for each value of `day`, in parts of at most most_rows."""
    rows.write.mode("append").partitionBy(day).option("maxRecordsPerFile", most_rows).json(path)
