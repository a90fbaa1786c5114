"""Result tables: nested page records, flat chunk records, failures, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.rollups import SUCCESS, run_totals, total_metrics, with_success_rate

#: Schema of one nested page record.
PAGE_RESULT_SCHEMA = """
    url STRING, title STRING, status STRING, extraction_method STRING,
    total_chunks BIGINT, total_tokens BIGINT, total_words BIGINT,
    chunks ARRAY<STRUCT<chunk_index: INT, content: STRING, chunk_id: STRING, tokens: INT,
        word_count: BIGINT, metadata: STRUCT<
            source: STRUCT<url: STRING, title: STRING, description: STRING, domain: STRING,
                crawled_at: TIMESTAMP, content_type: STRING>,
            processing: STRUCT<chunk_index: INT, total_chunks: INT, chunk_size: INT,
                processing_method: STRING, extraction_method: STRING,
                chunking_options: STRUCT<chunk_size: INT, chunk_overlap: INT>, error: STRING>,
            content: STRUCT<length: BIGINT, word_count: BIGINT, line_count: BIGINT,
                paragraph_count: BIGINT,
                structure: STRUCT<
                    headings: STRUCT<h1: BIGINT, h2: BIGINT, h3: BIGINT, h4: BIGINT, h5: BIGINT,
                        h6: BIGINT, total: BIGINT>,
                    lists: STRUCT<unordered: BIGINT, ordered: BIGINT>,
                    code_blocks: DOUBLE, inline_code: BIGINT, links: BIGINT, images: BIGINT,
                    tables: BIGINT, blockquotes: BIGINT>,
                content_type: STRING,
                readability: STRUCT<words_per_sentence: DOUBLE, characters_per_word: DOUBLE,
                    reading_minutes: BIGINT>>,
            custom: MAP<STRING, STRING>>>>,
    error STRING, error_stage STRING, timestamp TIMESTAMP
"""


def write_page_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Nested page records, one row per page, as Parquet or JSON."""
    results.write.mode("overwrite").format(fmt).save(path)


def chunk_records(chunks: DataFrame, extracted_at: Column) -> DataFrame:
    """Flat records, one per chunk; the id is ``url#chunk-i``."""
    original = (
        F.col("original_length").cast("long")
        if "original_length" in chunks.columns
        else F.lit(0).cast("long")
    )
    return chunks.select(
        "url",
        U.host("url").alias("domain"),
        F.coalesce("title", F.lit("")).alias("title"),
        "content",
        F.col("content").alias("markdown"),
        "chunk_index",
        "total_chunks",
        F.length("content").alias("chunk_size"),
        F.coalesce("tokens", F.lit(0)).alias("token_count"),
        extracted_at.cast("timestamp").alias("extracted_at"),
        F.concat("url", F.lit("#chunk-"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        ((F.col("overlap_start") > 0) | (F.col("overlap_end") > 0)).alias("has_overlap"),
        original.alias("original_length"),
        F.lit("recursive-character-splitter").alias("chunking_method"),
    )


#: A domain is spread over this many files, so a huge site is not one writer's task.
FILES_PER_DOMAIN = 16


def write_chunk_records(records: DataFrame, path: str, files_per_domain: int = FILES_PER_DOMAIN) -> None:
    """Flat records as Parquet by domain; each domain's rows are salted over several tasks."""
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_domain))
    (
        records.withColumn("_salt", salt)
        .repartition("domain", "_salt")
        .drop("_salt")
        .write.mode("overwrite")
        .partitionBy("domain")
        .parquet(path)
    )


def failures(results: DataFrame) -> DataFrame:
    """Page records that did not succeed, with stage and message."""
    return results.where(F.col("status") != SUCCESS).select(
        "url", "title", "status", "error", "error_stage"
    )


def write_results(results: DataFrame, path: str, quarantine: str) -> None:
    """Good records to ``path``, failed ones to ``quarantine``."""
    write_page_results(results.where(F.col("status") == SUCCESS), path)
    failures(results).write.mode("overwrite").parquet(quarantine)


#: What :func:`write_run` observes of the records it writes.
RUN_METRICS = (
    "total_requests", "successful_requests", "failed_requests", "failed_extractions", "total_chunks", "total_tokens",
)


def write_run(results: DataFrame, path: str) -> DataFrame:
    """Page records and the totals of their run, in one pass over ``results``; returns the totals, one row.

    Records go to ``path/records`` by status, so failures are a folder of their own. The totals are taken from
    the rows as they are written and then put to ``path/statistics`` as JSON: the job behind ``results``
    runs once. Each task that succeeds counts once, a task that is repeated does not.
    """
    spark = results.sparkSession
    seen = Observation()
    results.observe(seen, *total_metrics()).write.mode("overwrite").partitionBy("status").parquet(f"{path}/records")
    row = seen.get
    totals = spark.createDataFrame(
        [tuple(int(row[m] or 0) for m in RUN_METRICS)], ", ".join(f"{m} BIGINT" for m in RUN_METRICS)
    )
    with_success_rate(totals).coalesce(1).write.mode("overwrite").json(f"{path}/statistics")
    return with_success_rate(totals)


def write_run_statistics(results: DataFrame, path: str) -> None:
    """One JSON row of run totals."""
    run_totals(results).coalesce(1).write.mode("overwrite").json(path)
