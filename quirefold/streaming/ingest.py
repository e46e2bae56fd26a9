"""Structured Streaming: incremental ingest of document lines, and windowed page statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.operators.pages import contents_features


def line_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Lines of documents that arrive as parquet files (doc_id, text)."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "text")).select("doc_id", (F.floor(F.col("_p") / 5) + 1).alias("page_num"), (F.col("_p") + 1).cast("long").alias("line_num"), "text")


def ingest_page_features(lines: DataFrame, out: str, checkpoint: str):
    """Process what is new and stop: each document is in one file, so a batch holds whole pages."""

    def write(batch: DataFrame, number: int) -> None:  # a repeated batch overwrites its own folder
        contents_features(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_confidence(boxes: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Tumbling windows over arriving boxes (ts, event_type, value), late ones dropped by the watermark."""
    return boxes.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))
