"""The batch plan over a stream of files: rows are independent, so there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans import invoices
from tallyspark.sources.options import Options


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Binary files as they arrive: (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents that need no codec: (path, text, markdown)."""
    rows = spark.readStream.schema("value string").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("value").alias("markdown"))


def parse_texts(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options | None = None):
    """Text documents to JSON results under ``target``; returns the running query."""
    results = invoices.to_json(invoices.result(invoices.structure(read_texts(spark, source), options)))
    return results.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
