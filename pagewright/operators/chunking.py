"""Documents to chunk rows; chunk positions, statistics and checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.core import is_blank, round_half_up
from ..functions.splitting import split_column
from ..session import cut_lineage
from .keyed import attach_by_key, positions, variance_pop

SEPARATORS = ("\n\n", "\n", " ", "")


def overlap_estimate(length: Column, overlap: int, present: Column) -> Column:
    """A tenth of the chunk, at most the configured overlap; 0 at the document's ends."""
    tenth = F.floor(length * F.lit(0.1)).cast("int")
    return F.when(present, F.least(F.lit(overlap), tenth)).otherwise(F.lit(0)).cast("int")


def with_positions(df: DataFrame, overlap: int) -> DataFrame:
    """First/last flags and overlap estimates from chunk_index, total_chunks and length."""
    first, last = F.col("chunk_index") == 0, F.col("chunk_index") == F.col("total_chunks") - 1
    return df.withColumns(
        {
            "is_first": first,
            "is_last": last,
            "overlap_start": overlap_estimate(F.col("length"), overlap, ~first),
            "overlap_end": overlap_estimate(F.col("length"), overlap, ~last),
        }
    )


def chunk_documents(
    docs: DataFrame,
    text: str,
    size: int = 1000,
    overlap: int = 100,
    separators: Sequence[str] = SEPARATORS,
    keep_separator: bool = False,
    length: str | Callable[[str], int] = len,
    keep_empty: bool = False,
    count: Callable[[str], int] | None = None,
) -> DataFrame:
    """One row per chunk, with every column of ``docs`` but the text.

    Blank documents give no rows, or with ``keep_empty`` one row without a chunk. Offsets count from the cleaned text. Rows are
    split where they are: there is no shuffle, and the layout of ``docs`` by
    its key carries over to the chunks. ``length`` is a name (chars, tokens, ...) or a function.
    With ``count`` a column ``tokens`` holds what it says of each chunk, NULL where there is none.
    """
    keep = [c for c in docs.columns if c != text]
    arrays = (
        docs.select(*keep, T.clean(text).alias("_clean"))
        .select(
            *keep,
            split_column(
                F.col("_clean"), size, overlap, separators, keep_separator, length, count
            ).alias("_chunks"),
        )
        .select(*keep, F.size("_chunks").alias("total_chunks"), "_chunks")
    )
    # posexplode would make the optimizer filter on size(split(text)) > 0 below it,
    # and so split every text twice; the outer form with a filter above does not.
    rows = arrays.select(
        *keep, "total_chunks", F.posexplode_outer("_chunks").alias("chunk_index", "_c")
    )
    rows = (rows if keep_empty else rows.where(F.col("_c").isNotNull())).select(
        *keep,
        "chunk_index",
        "total_chunks",
        F.col("_c.content").alias("content"),
        F.length("_c.content").alias("length"),
        F.col("_c.start_offset").alias("start_offset"),
        F.col("_c.end_offset").alias("end_offset"),
        *([F.col("_c.tokens").alias("tokens")] if count is not None else []),
    )
    return with_positions(rows, overlap)


def document_warnings(docs: DataFrame, text: str) -> DataFrame:
    """Warnings per document: empty input, lost text, many code blocks."""
    keep = [c for c in docs.columns if c != text]
    c = F.col(text)
    return docs.select(*keep, c, T.clean(text).alias("_clean")).select(
        *keep,
        F.when(is_blank(text), F.array(F.lit("Input text is empty")))
        .otherwise(T.clean_warnings(c, F.col("_clean")))
        .alias("warnings"),
    )


def locate_chunks(chunks: DataFrame, key: str, overlap: int) -> DataFrame:
    """Totals, flags and overlap estimates for a table of (key, chunk_index, content)."""
    totals = cut_lineage(chunks.groupBy(key).agg(F.count("*").alias("total_chunks")))
    rows = attach_by_key(chunks, totals, [key], "total_chunks", ["total_chunks"], ["chunk_index"])
    return with_positions(rows.withColumn("length", F.length("content")), overlap)


def chunk_stats(chunks: DataFrame, key: str, original_length: str) -> DataFrame:
    """Size and overlap statistics per document; ``original_length`` is a column of ``chunks``."""
    n, size = F.col("total_chunks"), F.col("length").cast("long")
    agg = chunks.groupBy(key).agg(
        F.count("*").alias("total_chunks"),
        F.sum(size).alias("_sum"),
        F.sum(size * size).alias("_sq"),
        F.min(size).alias("min_chunk_size"),
        F.max(size).alias("max_chunk_size"),
        F.sum((F.col("overlap_start") + F.col("overlap_end")).cast("long")).alias("overlap_chars"),
        F.max(F.col(original_length)).cast("double").alias("_orig"),
    )
    orig = F.col("_orig")
    return agg.select(
        key,
        "total_chunks",
        round_half_up(F.col("_sum") / n).alias("average_chunk_size"),
        "min_chunk_size",
        "max_chunk_size",
        round_half_up(variance_pop(n, F.col("_sum"), F.col("_sq"))).alias("size_variance"),
        "overlap_chars",
        F.when(orig > 0, round_half_up(F.col("overlap_chars") / orig, 3)).otherwise(0.0).alias("overlap_ratio"),
        F.when(orig > 0, F.col("_sum") / orig).otherwise(1.0).alias("compression_ratio"),
        F.when(orig > 0, n / (orig / 1024.0)).otherwise(0.0).alias("chunks_per_kb"),
    )


def validate_chunks(chunks: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """Issue rows (key, chunk_index, kind, severity, message) for chunks that break a rule."""
    ranked = positions(
        chunks.select(key, "chunk_index", "content", "length", "overlap_start"),
        key, "chunk_index", ["length"],
    )
    at = F.col("position").cast("string")
    expected = F.least(F.lit(overlap), F.col("prev_length"), F.col("length"))

    def issue(cond: Column, kind: str, severity: str, *message: Column | str) -> Column:
        text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
        return F.when(
            cond,
            F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), text.alias("message")),
        )

    issues = F.array_compact(
        F.array(
            issue(
                F.col("content").isNull() | (F.col("content") == ""),
                "content", "error", "Chunk ", at, " has invalid content",
            ),
            issue(
                F.col("chunk_index") != F.col("position"),
                "index", "warning", "Chunk ", at, " has mismatched index: ", F.col("chunk_index").cast("string"),
            ),
            issue(
                F.col("length") > size * 1.5,
                "size", "warning", "Chunk ", at, " exceeds expected size: ", F.col("length").cast("string"), " chars",
            ),
            issue(
                (F.col("position") > 0) & (F.col("overlap_start") > expected * 1.2),
                "overlap", "warning", "Chunk ", at, " has excessive overlap start: ",
                F.col("overlap_start").cast("string"),
            ),
        )
    )
    return ranked.select(key, "chunk_index", F.explode(issues).alias("_i")).select(
        key, "chunk_index", "_i.kind", "_i.severity", "_i.message"
    )
