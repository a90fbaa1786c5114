"""Source, processing and content metadata on chunk rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.core import blank_to_null, is_blank, round_half_up, warnings_of

# Fixed value: name of the split method in chunk records.
METHOD = "langchain-recursive"

Enricher = Callable[[Column, Column, Column], Column]


def _or_empty(df: DataFrame, name: str, default: str = "") -> Column:
    if name not in df.columns:
        return F.lit(default)
    c = F.col(name)
    return F.coalesce(F.when(c != "", c), F.lit(default))


def source_metadata(df: DataFrame, crawled_at: Column) -> Column:
    """Source struct from the columns url, title, description, content_type where present.

    A URL that does not parse becomes ''; a blank title becomes the domain or ``Unknown``.
    """
    url = F.when(U.is_http_url("url"), F.col("url")).otherwise("")
    domain = U.host("url")
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    return F.struct(
        url.alias("url"),
        F.coalesce(blank_to_null(title), blank_to_null(domain), F.lit("Unknown")).alias("title"),
        _or_empty(df, "description").alias("description"),
        domain.alias("domain"),
        crawled_at.cast("timestamp").alias("crawled_at"),
        _or_empty(df, "content_type", "text/markdown").alias("content_type"),
    )


def source_warnings(url: Column | str, title: Column | str) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    missing = u.isNull() | (u == "")
    return warnings_of(
        (~missing & ~U.is_http_url(u), F.concat(F.lit("Invalid source URL: "), u)),
        (missing, "No source URL provided"),
        (is_blank(title), "No source title provided"),
    )


def processing_metadata(df: DataFrame, method: str, size: int, overlap: int) -> Column:
    return F.struct(
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("total_chunks").cast("int").alias("total_chunks"),
        F.length("content").alias("chunk_size"),
        F.lit(method).alias("processing_method"),
        _or_empty(df, "extraction_method", "unknown").alias("extraction_method"),
        F.struct(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap")).alias("chunking_options"),
        F.lit(None).cast("string").alias("error"),
    )


def python_enricher(fn: Callable[[str | None, dict[str, str], int], dict[str, str] | None]) -> Enricher:
    """An enricher from a Python function of (content, map so far, chunk index), run in Arrow batches.

    The map it returns replaces the map so far, so it may also remove keys; None leaves it. If
    it raises, the row stays as it was and the message goes to ``processing.error``.
    """

    @F.pandas_udf("fields map<string,string>, error string")
    def run(content: pd.Series, fields: pd.Series, index: pd.Series) -> pd.DataFrame:
        out = []
        for text, old, i in zip(content, fields, index):
            try:
                new = fn(text, dict(old), i)
                out.append((old if new is None else {str(k): None if v is None else str(v) for k, v in new.items()}, None))
            except Exception as e:  # the function is the caller's; its fault must not end the job
                out.append((old, f"Custom enricher failed: {e}"))
        return pd.DataFrame(out, columns=["fields", "error"])

    run.replaces = True
    return run


def _put_over(fields: Column, extra: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, v: ~F.map_contains_key(extra, k)), extra)


def apply_enrichers(rows: DataFrame, custom: Column, enrichers: Sequence[Enricher]) -> DataFrame:
    """``rows`` with ``custom``, the map after all enrichers, and ``_enricher_error``, the first failure.

    An enricher gets (content, map so far, chunk index) as columns. One made of column functions
    returns a map<string,string>, whose keys are put over the map so far; NULL leaves it
    unchanged. For Python functions see :func:`python_enricher`.
    """
    out = rows.withColumns({"custom": custom, "_enricher_error": F.lit(None).cast("string")})
    for enricher in enrichers:
        found = enricher(F.col("content"), F.col("custom"), F.col("chunk_index"))
        if getattr(enricher, "replaces", False):
            out = out.withColumn("_found", found).withColumns(
                {"custom": F.col("_found.fields"), "_enricher_error": F.coalesce("_enricher_error", "_found.error")}
            ).drop("_found")
        else:
            extra = F.coalesce(found, F.create_map().cast("map<string,string>"))
            out = out.withColumn("custom", _put_over(F.col("custom"), extra))
    return out


def enrich(
    chunks: DataFrame,
    crawled_at: Column,
    size: int = 1000,
    overlap: int = 100,
    method: str = METHOD,
    custom: Column | None = None,
    enrichers: Sequence[Enricher] = (),
    max_metadata_size: int = 10_000,
) -> DataFrame:
    """Add chunk_id, source, processing, content_meta and custom to chunk rows."""
    base = custom if custom is not None else F.create_map().cast("map<string,string>")
    # Text that cannot be analysed keeps its row; the reason goes to processing.error.
    failed = F.col("content").isNull()
    # The counts come first, as columns, so that what is built from them reuses them.
    counted = chunks.withColumns({"_structure": T.structure("content"), "_words": T.word_count("content")})
    counted = apply_enrichers(counted, base, enrichers)
    rows = counted.withColumns(
        {
            "chunk_id": T.chunk_id("url", "chunk_index", F.coalesce("content", F.lit(""))),
            "source": source_metadata(chunks, crawled_at),
            "processing": processing_metadata(chunks, method, size, overlap).withField(
                "error", F.when(failed, "content must be a string").otherwise(F.col("_enricher_error"))
            ),
            "content_meta": F.when(~failed, T.analysis("content", F.col("_structure"), F.col("_words"))),
        }
    ).drop("_structure", "_words", "_enricher_error")
    return limit_metadata(rows, max_metadata_size)


def metadata_size() -> Column:
    """Characters of the metadata as JSON."""
    return F.length(F.to_json(F.struct("source", "processing", "content_meta", "custom"))).cast("long")


def limit_metadata(rows: DataFrame, limit: int) -> DataFrame:
    """Over ``limit`` characters of JSON: structure becomes NULL and custom empty."""
    large = F.col("_size") > limit
    meta = F.col("content_meta")
    nothing = F.lit(None).cast(rows.schema["content_meta"].dataType["structure"].dataType)
    return (
        rows.withColumn("_size", metadata_size())
        .withColumns(
            {
                "content_meta": F.when(large, meta.withField("structure", nothing)).otherwise(meta),
                "custom": F.when(large, F.create_map().cast("map<string,string>")).otherwise(F.col("custom")),
            }
        )
        .drop("_size")
    )


def enrichment_facts() -> list[Column]:
    """What :func:`enrichment_stats` needs of a row: kind, meta_size, len, enriched."""
    return [
        F.coalesce(F.col("content_meta.content_type"), F.lit("unknown")).alias("kind"),
        metadata_size().alias("meta_size"),
        F.length(F.coalesce("content", F.lit(""))).cast("long").alias("len"),
        F.col("processing.error").isNull().cast("long").alias("enriched"),
    ]


def enrichment_stats(rows: DataFrame) -> DataFrame:
    """One row: counts, metadata sizes, content-type histogram, share enriched without error, average length."""
    return facts_stats(rows.select(*enrichment_facts()))


def facts_stats(facts: DataFrame) -> DataFrame:
    """The statistics from the columns of :func:`enrichment_facts`."""
    parts = facts.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("meta_size").alias("size"), F.sum("len").alias("len"), F.sum("enriched").alias("ok")
    )
    n, size = F.sum("n"), F.sum("size")
    return parts.agg(
        F.coalesce(n, F.lit(0)).alias("total_chunks"),
        F.coalesce(size, F.lit(0)).alias("total_metadata_size"),
        F.coalesce(round_half_up(F.try_divide(size, n)), F.lit(0)).alias("average_metadata_size"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("content_types"),
        F.coalesce(F.try_divide(F.sum("ok"), n), F.lit(0.0)).alias("enrichment_success"),
        F.coalesce(F.try_divide(F.sum("len"), n), F.lit(0.0)).alias("average_content_length"),
    )
