"""Where results go: JSON lines, and artifacts of a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.invoices import result, to_json
from tallyspark.sources.options import Options


def write_json(results: DataFrame, path: str) -> None:
    """One JSON text a document, nulls written."""
    to_json(results).select("json").write.mode("overwrite").text(path)


def write_artifacts(results: DataFrame, path: str, name: str, column: str, request: str = "request_id", on: bool = True) -> None:
    """``path/request_id=.../name=...`` with the non-empty texts of a column; nothing where artifacts are off."""
    if on:
        rows = results.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "")
        rows.select(F.col(column).cast("string").alias("value"), F.col(request).alias("request_id"), F.lit(name).alias("name")).write.mode("append").partitionBy("request_id", "name").text(path, lineSep="\n")


def write_byte_artifacts(results: DataFrame, path: str, name: str, column: str, request: str = "request_id", on: bool = True) -> None:
    """The non-empty bytes of a column, as Parquet (value) in ``path/request_id=.../name=...``."""
    if on:
        rows = results.where(F.octet_length(F.col(column)) > 0)
        rows.select(F.col(column).alias("value"), F.col(request).alias("request_id"), F.lit(name).alias("name")).write.mode("append").partitionBy("request_id", "name").parquet(path)


def archive(structured: DataFrame, path: str, options: Options | None = None, request: str = "request_id") -> None:
    """What the stages saw of each request, if artifacts are switched on: ``reader.md`` and ``raw.json``."""
    on = (options or Options()).save_artifacts
    write_artifacts(structured, path, "reader.md", "markdown", request, on)
    raw = structured.where("status = 200").withColumn("raw_json", F.to_json("raw", {"ignoreNullFields": "false"}))
    write_artifacts(raw, path, "raw.json", "raw_json", request, on)


def write_job(structured: DataFrame, path: str, artifacts: str, options: Options | None = None, request: str = "request_id") -> None:
    """Results as JSON lines, and artifacts beside them; the stages run once for both."""
    kept = structured.persist() if (options or Options()).save_artifacts else structured
    try:
        write_json(result(kept), path)
        archive(kept, artifacts, options, request)
    finally:
        kept.unpersist()
