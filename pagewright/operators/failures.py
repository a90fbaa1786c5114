"""Failure rows: category, severity, retry flag, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col

# Words of a message that tell its category, in order.
CATEGORY_WORDS = (
    ("network", ("network", "econnreset", "enotfound")),
    ("timeout", ("timeout", "etimedout")),
    ("rate_limit", ("rate limit", "too many requests")),
)
RETRYABLE = ("network", "timeout", "rate_limit")
SEVERITY = {"memory": "high", "network": "medium", "timeout": "medium", "rate_limit": "low"}


def category(message: Column | str) -> Column:
    text = F.lower(F.coalesce(col(message), F.lit("")))
    out = F.lit("unknown")
    for name, words in reversed(CATEGORY_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def severity(cat: Column | str) -> Column:
    c = col(cat)
    out = F.lit("medium")
    for name, level in SEVERITY.items():
        out = F.when(c == name, level).otherwise(out)
    return out


def retryable(cat: Column | str) -> Column:
    return col(cat).isin(*RETRYABLE)


def classify(failures: DataFrame, message: str = "message") -> DataFrame:
    return failures.withColumn("category", category(message)).withColumns(
        {"severity": severity("category"), "retryable": retryable("category")}
    )


def error_stats(classified: DataFrame) -> DataFrame:
    """Counts as (dimension, key, n): per category, per severity, and the total."""
    counts = classified.groupBy("category", "severity").agg(F.count("*").alias("n"))
    dims = F.array(
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("key")),
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("key")),
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("key")),
    )
    return (
        counts.select("n", F.explode(dims).alias("d")).groupBy("d.dimension", "d.key").agg(F.sum("n").alias("n"))
    )
