"""The same operators over streams: every detector is a stateless expression, so a stream of documents needs nothing else.

What needs state: repeated deliveries (dropped within a watermark), counts by window of arrival, and the latest review state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.operators.identifiers import identifiers
from velario.operators.spans import apply_replacements, numbered


def documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, loaded_at timestamp", files: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, key: str = "doc_id", at: str = "loaded_at", delay: str = "10 days") -> DataFrame:
    """Each key once within the watermark, so that the state stays bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def redacted(stream: DataFrame) -> DataFrame:
    """doc_id, loaded_at, n_spans, redacted of a stream or a table of documents."""
    d = stream.withColumn("spans", identifiers(F.col("text")))
    return d.select("doc_id", "loaded_at", F.size("spans").alias("n_spans"), apply_replacements(F.col("text"), numbered(F.col("spans"))).alias("redacted"))


def identifier_counts(stream: DataFrame, window: str = "1 day", delay: str = "10 days") -> DataFrame:
    """window_start, type, n by window of arrival; rows later than the watermark are left out by the engine."""
    e = stream.withWatermark("loaded_at", delay).select("loaded_at", F.explode(identifiers(F.col("text"))).alias("s"))
    return e.groupBy(F.window("loaded_at", window).start.alias("window_start"), F.col("s.type").alias("type")).agg(F.count("*").alias("n"))


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Everything that is there now, then stop; a restart goes on from the checkpoint. The folders must be shared by the executors."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
