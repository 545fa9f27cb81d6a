"""Ingestion as a stream: new chunk files become facts, counts of deliveries and windowed figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragframe.sources.jsonl import CHUNK


def chunk_stream(spark: SparkSession, root: str, files_at_once: int = 100) -> DataFrame:
    """Chunk rows of .jsonl files as they arrive."""
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.jsonl").json(root)


def distinct_chunks(stream: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Chunks that weren't delivered before, within the time that rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["relative_path", "chunk_id"])


def windowed_rate(events: DataFrame, at: str, width: str, late: str, value: str, budget: float) -> DataFrame:
    """Count and share over budget of each window of time."""
    w = F.window(F.col(at), width)
    return events.withWatermark(at, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(value) > budget, 1.0).otherwise(0.0)).alias("violation_rate")).select("w.start", "w.end", "n", "violation_rate")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to Parquet, and ends; a rerun goes on where the last one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
