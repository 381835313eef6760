"""Streaming ingest: pages land, are read, deduplicated by content and indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunk, lexical, readers


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(pages: DataFrame, text: str = "content", at: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Pages whose content was not seen within the delay; state is bounded by it."""
    return (
        pages.withColumn("content_hash", F.sha2(F.col(text), 256))
        .withWatermark(at, delay)
        .dropDuplicatesWithinWatermark(["content_hash"])
    )


def counts_by_window(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events per window and kind; late ones within the delay still count."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))


def index_stream(pages: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends the chunks and postings of new pages to Parquet.

    A batch is written below its number and overwritten if it runs again, so a
    restart leaves no duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        read = readers.read_markdown(batch.select("url", F.col("content")))
        chunks = chunk.chunk(read.where("not blocked").select(F.col("url").alias("doc_id"), F.col("body").alias("text")))
        chunks = chunks.persist()
        try:
            chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
            index = lexical.build(chunks.select(F.col("id").alias("chunk_id"), "text"))
            index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
            index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        finally:
            chunks.unpersist()

    return (
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_index(spark: SparkSession, path: str) -> lexical.Index:
    """The index that a stream has written so far."""
    return lexical.Index(
        spark.read.parquet(f"{path}/docs").drop("batch"), spark.read.parquet(f"{path}/postings").drop("batch")
    )
