"""Page records, run totals, rates and message lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import ratio, round_half_up
from ..session import cut_lineage
from .enrich import enrichment_facts, facts_stats
from .keyed import variance_pop
from .tokens import batch_totals, token_distribution

SUCCESS = "success"
EXTRACTION_FAILED = "extraction_failed"
CHUNKING_FAILED = "chunking_failed"
ERROR = "error"
REQUEST_FAILED = "request_failed"


def whole_ratio(a: Column, b: Column, scale: int = 1) -> Column:
    """round(a / b * scale), 0 where b is 0."""
    return round_half_up(ratio(a, b) * scale)


def page_rollup(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks, tokens and words per page."""
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("total_chunks"),
        F.sum(F.col("tokens").cast("long")).alias("total_tokens"),
        F.sum(F.col("word_count").cast("long")).alias("total_words"),
    )


def nest_chunks(chunks: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Page rows with their chunks as an array in chunk order, and the totals.

    A group is one page, whose text is bounded by the content length gate.
    """
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("total_chunks"),
        F.sum(F.col("tokens").cast("long")).alias("total_tokens"),
        F.sum(F.col("word_count").cast("long")).alias("total_words"),
        F.array_sort(F.collect_list(F.struct("chunk_index", *fields))).alias("chunks"),
    )


def total_metrics() -> list[Column]:
    """The sums of a run over page records (status, total_chunks, total_tokens)."""
    return [
        F.count("*").alias("total_requests"),
        F.count_if(F.col("status") == SUCCESS).alias("successful_requests"),
        F.count_if(F.col("status") == REQUEST_FAILED).alias("failed_requests"),
        F.count_if(F.col("status") == EXTRACTION_FAILED).alias("failed_extractions"),
        F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    ]


def with_success_rate(totals: DataFrame) -> DataFrame:
    return totals.withColumn(
        "success_rate", whole_ratio(F.col("successful_requests"), F.col("total_requests"), 100)
    )


def run_totals(pages: DataFrame) -> DataFrame:
    """One row over page records (status, total_chunks, total_tokens)."""
    return with_success_rate(pages.agg(*total_metrics()))


def crawl_rates(pages: DataFrame, seconds: float | Column) -> DataFrame:
    """Success rate, pages per second, chunks per page and tokens per chunk."""
    took = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    ok, chunks = F.col("successful_requests"), F.col("total_chunks")
    return run_totals(pages).select(
        "success_rate",
        whole_ratio(ok, took).alias("pages_per_second"),
        whole_ratio(chunks, ok).alias("chunks_per_page"),
        whole_ratio(F.col("total_tokens"), chunks).alias("tokens_per_chunk"),
    )


def _corpus_chunking(chunks: DataFrame, key: str, original_length: str) -> DataFrame:
    """One row of size and overlap statistics over all documents."""
    size = F.col("length").cast("long")
    per_doc = chunks.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(size).alias("sum"), F.sum(size * size).alias("sq"), F.min(size).alias("least"), F.max(size).alias("most"),
        F.sum((F.col("overlap_start") + F.col("overlap_end")).cast("long")).alias("overlap"), F.max(original_length).cast("long").alias("original"),
    )
    total = per_doc.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "sum", "sq", "overlap", "original")],
        F.min("least").alias("min_chunk_size"), F.max("most").alias("max_chunk_size"),
    )
    n, original = F.col("n"), F.col("original")
    return total.select(
        n.alias("total_chunks"),
        whole_ratio(F.col("sum"), n).alias("average_chunk_size"),
        "min_chunk_size", "max_chunk_size",
        round_half_up(variance_pop(n, F.col("sum"), F.col("sq"))).alias("size_variance"),
        F.col("overlap").alias("overlap_chars"),
        round_half_up(ratio(F.col("overlap"), original), 3).alias("overlap_ratio"),
        F.when(original > 0, F.col("sum") / original).otherwise(1.0).alias("compression_ratio"),
        F.when(original > 0, n / (original / 1024.0)).otherwise(0.0).alias("chunks_per_kb"),
    )


def stage_stats(
    chunks: DataFrame, key: str, original_length: str, include_enrichment: bool = True, processing_ms: float | Column | None = None
) -> DataFrame:
    """The stages of a run over a corpus as (stage, metric, value) rows.

    Stages are chunking, tokenization, distribution (of tokens), enrichment, content_types (chunks of each) and, given the
    run's time in milliseconds, performance. ``chunks`` are read once: what the stages need of a row is narrow and kept.
    """
    facts = [F.col(c) for c in (key, original_length, "length", "overlap_start", "overlap_end", "tokens", "word_count", "cost")]
    chunks = cut_lineage(chunks.select(*facts, *(enrichment_facts() if include_enrichment else [])))
    totals = batch_totals(chunks)
    stages = [
        ("chunking", _corpus_chunking(chunks, key, original_length)),
        ("tokenization", totals),
        ("distribution", token_distribution(chunks)),
    ]
    if processing_ms is not None:
        took = processing_ms if isinstance(processing_ms, Column) else F.lit(float(processing_ms))
        seconds = took / 1000.0
        speed = totals.select(
            took.alias("total_processing_time"),
            F.coalesce(F.try_divide(F.col("chunks"), seconds), F.lit(0.0)).alias("chunks_per_second"),
            F.coalesce(F.try_divide(F.col("total_tokens"), seconds), F.lit(0.0)).alias("tokens_per_second"),
            F.coalesce(F.try_divide(took, F.col("chunks")), F.lit(0.0)).alias("average_time_per_chunk"),
        )
        stages.append(("performance", speed))
    kinds = None
    if include_enrichment:
        stages.append(("enrichment", facts_stats(chunks).drop("content_types")))
        kinds = chunks.groupBy(F.col("kind").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    out = None if kinds is None else kinds.select(F.lit("content_types").alias("stage"), "metric", "value")
    for stage, df in stages:
        long = df.select([F.col(c).cast("double") for c in df.columns]).unpivot(
            [], df.columns, "metric", "value"
        ).select(F.lit(stage).alias("stage"), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def union_messages(**sources: DataFrame) -> DataFrame:
    """Errors or warnings of several components with a ``source`` tag; a missing url is ''."""
    out = None
    for name, df in sources.items():
        rows = df.select(
            "message",
            F.coalesce("url", F.lit("")).alias("url"),
            F.lit(name).alias("source"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def join_token_results(chunks: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks with their token results; a chunk without a result gets zeros."""
    return chunks.join(results, list(keys), "left").withColumns(
        {
            "tokens": F.coalesce("tokens", F.lit(0)),
            "cost": F.coalesce("cost", F.lit(0.0)),
            "tokens_per_character": F.coalesce("tokens_per_character", F.lit(0.0)),
            "tokens_per_word": F.coalesce("tokens_per_word", F.lit(0.0)),
        }
    )
