"""Corpus reports against plain Python, and chunk keys."""

import statistics

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import enrich as E
from pagewright.operators import rollups as R
from pagewright.operators import tokens as TK
from pagewright.operators.chunking import chunk_documents

DOCS = [(i, "http://x.org/a", f"# Title {i}\n\n" + "Some words of a text, `code` and [a](b). " * (i % 7 * 20)) for i in range(30)]


def rows_of(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, url string, markdown string").withColumn("title", F.lit("T")).withColumn("original", F.length("markdown"))
    chunks = chunk_documents(docs, "markdown", 300, 50)
    enriched = E.enrich(chunks, F.lit("2024-01-01").cast("timestamp"), 300, 50)
    return TK.with_token_columns(enriched.withColumn("tokens", F.length("content")), "content")


def test_stages_hold_all_metrics(spark):
    rows = rows_of(spark).cache()
    got = {(r.stage, r.metric): r.value for r in R.stage_stats(rows, "doc_id", "original", processing_ms=4000).collect()}
    chunks = rows.select("doc_id", "length", "overlap_start", "overlap_end", "cost", "word_count", "original").collect()
    n, sizes = len(chunks), [r.length for r in chunks]
    original = sum({r.doc_id: r.original for r in chunks}.values())
    overlap = sum(r.overlap_start + r.overlap_end for r in chunks)
    want = {
        ("chunking", "total_chunks"): n,
        ("chunking", "average_chunk_size"): int(sum(sizes) / n + 0.5),
        ("chunking", "size_variance"): int(statistics.pvariance(sizes) + 0.5),
        ("chunking", "overlap_ratio"): int(overlap / original * 1000 + 0.5) / 1000,
        ("performance", "chunks_per_second"): n / 4,
        ("performance", "tokens_per_second"): sum(sizes) / 4,
        ("performance", "average_time_per_chunk"): 4000 / n,
        ("tokenization", "total_tokens"): sum(sizes),
        ("distribution", "median"): statistics.median(sizes),
    }
    for key, value in want.items():
        assert abs(got[key] - value) < 1e-9, key
    meta = [len(r[0]) for r in rows.select(F.to_json(F.struct("source", "processing", "content_meta", "custom"))).collect()]
    assert got["enrichment", "total_metadata_size"] == sum(meta)
    assert got["enrichment", "average_metadata_size"] == int(sum(meta) / n + 0.5)
    assert sum(v for (s, _), v in got.items() if s == "content_types") == n
    rows.unpersist()


def test_stages_of_nothing(spark):
    rows = rows_of(spark).limit(0)
    got = {(r.stage, r.metric): r.value for r in R.stage_stats(rows, "doc_id", "original", processing_ms=0).collect()}
    assert got["chunking", "total_chunks"] == 0 and got["performance", "chunks_per_second"] == 0


def test_keys_tell_parts_apart(spark):
    parts = [("a", 1, "b"), ("a:1", 1, "b"), ("a", 11, "b"), ("a", 1, "1:b"), (None, 1, "ab"), ("ab", 1, None), ("", 1, "ab")]
    df = spark.createDataFrame(parts, "url string, i int, content string")
    keys = [r[0] for r in df.select(T.chunk_key("url", "i", "content")).collect()]
    assert len(set(keys)) == len(parts) - 1 and keys[4] == keys[6] and all(len(k) == 32 for k in keys)
