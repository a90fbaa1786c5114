"""Streaming forms of the page job, the visited-URL check and the metric roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls as U
from ..operators.metrics import exact_sum
from ..params import PageJobParams
from ..plans.pages import page_chunks
from ..sources.tables import PAGE_SCHEMA

EVENT_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Pages from a growing folder, with the arrival time of their file."""
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).select(
        "*", F.col("_metadata.file_modification_time").alias("arrived")
    )


def stream_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def chunk_pages(
    pages: DataFrame,
    out: str,
    checkpoint: str,
    params: PageJobParams | None = None,
    crawled_at: Column | None = None,
) -> StreamingQuery:
    """Page stream to chunk table. A batch writes its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        page_chunks(batch.select("page_id", "url", "html"), params, crawled_at).write.mode(
            "overwrite"
        ).parquet(f"{out}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_visits(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each normalised URL once within the watermark of its arrival time."""
    return (
        pages.select("page_id", "url", U.normalize("url").alias("norm_url"), "arrived")
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["norm_url"])
    )


def windowed_metrics(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Count, sum and peak per tumbling window and name; rows behind the watermark are dropped."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("name"))
        .agg(
            F.count("*").alias("n"),
            exact_sum("value").cast("double").alias("total"),
            F.max("value").alias("peak"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "name", "n", "total", "peak")
    )


def running_totals(rows: DataFrame, by: str = "status") -> DataFrame:
    """Running count and sum per status, for update or complete mode."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), exact_sum("value").cast("double").alias("total"))


def append_to(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a Parquet table until the input is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def replace_table(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the complete result of each batch to its own folder; the last one is current."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
