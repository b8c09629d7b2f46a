"""Incremental ingestion: new files of a folder become chunks once, and finished documents are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.chunking import chunk_routed
from folio.operators.classify import route


def documents_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, source_path string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def first_arrivals(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Documents that are delivered again within the delay count once."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"])


def ingest(stream: DataFrame, out: str, checkpoint: str, limit: int = 1500):
    """Route and chunk each new document and append its chunks to the table at ``out``; runs on what is there and stops."""
    chunks = chunk_routed(route(first_arrivals(stream)), limit)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by type and window of time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
