"""Extension: files as they arrive. Structured Streaming hands each new micro-batch to the analysis; functions whose
bodies were seen before are not analyzed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.extract import extract, unnest


def stream_sources(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (file_id, path, text, seen_at)."""
    s = spark.readStream.text(path, wholetext=True, recursiveFileLookup=True)
    p = F.col("_metadata.file_path")
    return s.select(F.xxhash64(p).alias("file_id"), p.alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("seen_at"))


def new_functions(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Functions by the hash of their body, once each. The state has a row for each body; with a watermark bodies are
    forgotten that long, by the files' own times, behind the latest file, and files older than that aren't read."""
    if watermark is None:
        return unnest(extract(stream), "functions").dropDuplicates(["function_hash"])
    read = extract(stream.withWatermark("seen_at", watermark), "seen_at")
    return read.select("file_id", "seen_at", F.explode("functions").alias("x")).select("file_id", "seen_at", "x.*").dropDuplicatesWithinWatermark(["function_hash"])


def write_new_functions(stream: DataFrame, target: str, checkpoint: str):
    """Starts a query that appends new functions to a Parquet table."""
    return new_functions(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
