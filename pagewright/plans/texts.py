"""Text job: documents to chunked, enriched, counted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import token_counter
from ..operators.chunking import chunk_documents
from ..operators.enrich import enrich
from ..operators.rollups import CHUNKING_FAILED, SUCCESS
from ..operators.tokens import with_tokens
from ..params import PageJobParams


def process_texts(
    docs: DataFrame,
    text: str = "markdown",
    params: PageJobParams | None = None,
    crawled_at: Column | None = None,
    keep_failed: bool = True,
    **enrich_options,
) -> DataFrame:
    """Chunk, enrich and count every document of a table; ``docs`` has a ``url`` column.

    A document without text keeps one row without a chunk, with status ``chunking_failed``;
    ``keep_failed=False`` leaves it out. The whole job is one narrow stage: no shuffle
    between scan and result.
    """
    p = params or PageJobParams()
    when = F.current_timestamp() if crawled_at is None else crawled_at
    chunks = chunk_documents(docs, text, p.chunk_size, p.chunk_overlap, p.separators, keep_empty=keep_failed, count=token_counter())
    enriched = enrich(
        chunks, when, p.chunk_size, p.chunk_overlap,
        max_metadata_size=p.max_metadata_size, **enrich_options,
    )
    counted = with_tokens(enriched, "content", p.model, p.price_overrides, counted="tokens")
    return counted.withColumns(
        {
            "status": F.when(F.col("content").isNull(), CHUNKING_FAILED).otherwise(SUCCESS),
            "error": F.when(F.col("content").isNull(), "No chunks generated"),
        }
    )
