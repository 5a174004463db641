"""Ingest of documents as files arrive: an extension, the batch readers being the base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quire.sources import readers


def arriving_documents(spark: SparkSession, folder: str, *, files_a_batch: int = 1000) -> DataFrame:
    """document_id, text of files as they arrive, read as the batch reader does."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return readers.decoded(raw).select("document_id", "text")


def arriving_events(spark: SparkSession, folder: str, schema: str, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and sums of events by window and type, events up to ``late`` behind being counted; a window is given out once it is closed."""
    raw = spark.readStream.schema(schema).parquet(folder)
    stamped = raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def keep(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived, once, to Parquet; documents by name only the first time within the checkpoint's life."""
    unique = stream.dropDuplicates(["document_id"]) if "document_id" in stream.columns else stream
    return unique.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
