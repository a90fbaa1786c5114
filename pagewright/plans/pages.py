"""Page job: stored pages to Markdown, chunks, and nested page records.

Every page row gets a key of its own, so pages may share an id, or have none, and each
still becomes one record. Pages are laid out by that key once. Tokens, regions, Markdown and
chunks stay inside those partitions; the final nesting shuffles one partial record per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_counter
from ..operators.chunking import chunk_documents
from ..operators.content import extract_content, gate_content, laid_out, with_row_key, with_source_id
from ..operators.enrich import enrich
from ..operators.markdown import render_markdown
from ..operators.rollups import CHUNKING_FAILED, SUCCESS
from ..operators.tokens import with_tokens
from ..params import PageJobParams

PAGE_FIELDS = ("page_id", "source_page_id", "url", "title", "status", "extraction_method", "error", "error_stage")


def _keyed_content(pages: DataFrame, p: PageJobParams, preserve_code: bool = False) -> DataFrame:
    """As :func:`page_content`, with page_id the row key and source_page_id the page's id."""
    extracted = extract_content(laid_out(with_row_key(pages.select("page_id", "url", "html"))), p)
    return gate_content(render_markdown(extracted, preserve_code=preserve_code), p)


def page_content(
    pages: DataFrame, params: PageJobParams | None = None, preserve_code: bool = False
) -> DataFrame:
    """Title, method, Markdown, plain text, status and messages, one row per page row."""
    return with_source_id(_keyed_content(pages, params or PageJobParams(), preserve_code))


def page_chunks(
    pages: DataFrame,
    params: PageJobParams | None = None,
    crawled_at: Column | None = None,
    keep_failed: bool = False,
    **enrich_options,
) -> DataFrame:
    """Enriched, counted chunk rows of the pages that succeed.

    With ``keep_failed``, pages without chunks keep one row with NULL content.
    """
    return with_source_id(_keyed_chunks(pages, params, crawled_at, keep_failed, **enrich_options))


def _keyed_chunks(
    pages: DataFrame,
    params: PageJobParams | None = None,
    crawled_at: Column | None = None,
    keep_failed: bool = False,
    **enrich_options,
) -> DataFrame:
    p = params or PageJobParams()
    when = F.current_timestamp() if crawled_at is None else crawled_at
    content = _keyed_content(pages, p).select(
        "page_id", "source_page_id", "url", "title", F.col("excerpt").alias("description"),
        F.col("method").alias("extraction_method"), "status", "error", "error_stage",
        F.length("markdown").alias("original_length"),
        F.when(F.col("status") == SUCCESS, F.col("markdown")).alias("markdown"),
    )
    chunks = chunk_documents(
        content, "markdown", p.chunk_size, p.chunk_overlap, p.separators, keep_empty=keep_failed, count=token_counter()
    )
    enriched = enrich(
        chunks, when, p.chunk_size, p.chunk_overlap, max_metadata_size=p.max_metadata_size, **enrich_options
    )
    return with_tokens(enriched, "content", p.model, p.price_overrides, counted="tokens")


def page_results(
    pages: DataFrame, params: PageJobParams | None = None, crawled_at: Column | None = None, **enrich_options
) -> DataFrame:
    """One nested record per page, failed pages included, as in ``PAGE_RESULT_SCHEMA``."""
    when = F.current_timestamp() if crawled_at is None else crawled_at
    rows = _keyed_chunks(pages, params, when, keep_failed=True, **enrich_options)
    has_chunk = F.col("content").isNotNull()
    chunk = F.struct(
        F.col("chunk_index").cast("int").alias("chunk_index"), "content", "chunk_id", "tokens", "word_count",
        F.struct(
            "source", "processing", F.col("content_meta").alias("content"), "custom"
        ).alias("metadata"),
    )
    # A map cannot be compared, so chunks are sorted by their index alone.
    by_index = F.collect_list(F.when(has_chunk, chunk))
    ordered = F.array_sort(
        by_index,
        lambda a, b: F.when(a["chunk_index"] < b["chunk_index"], -1)
        .when(a["chunk_index"] > b["chunk_index"], 1)
        .otherwise(0),
    )
    nested = rows.groupBy(*PAGE_FIELDS).agg(
        F.count_if(has_chunk).alias("total_chunks"),
        F.coalesce(F.sum(F.when(has_chunk, F.col("tokens")).cast("long")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(has_chunk, F.col("word_count")).cast("long")), F.lit(0)).alias("total_words"),
        ordered.alias("chunks"),
    )
    no_chunks = (F.col("status") == SUCCESS) & (F.col("total_chunks") == 0)
    return nested.select(
        "url", "title",
        F.when(no_chunks, CHUNKING_FAILED).otherwise(F.col("status")).alias("status"),
        "extraction_method", "total_chunks", "total_tokens", "total_words", "chunks",
        F.when(no_chunks, "No chunks generated").otherwise(F.col("error")).alias("error"),
        "error_stage",
        when.cast("timestamp").alias("timestamp"),
    )
