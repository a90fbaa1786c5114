"""Scans of the input tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"
SEED_SCHEMA = "url STRING"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pages(
    spark: SparkSession, path: str, fmt: str = "parquet", min_length: int = 0
) -> DataFrame:
    """Stored pages; with ``min_length``, those with html of at least so many characters.

    The page job wants all of them: it records short pages as failures.
    """
    reader = spark.read.format(fmt)
    pages = (reader if fmt == "parquet" else reader.schema(PAGE_SCHEMA)).load(path)
    pages = pages.select("page_id", "url", "html")
    return pages.where(F.length("html") >= min_length) if min_length else pages


def seed_urls(raw: DataFrame, column: str = "seed") -> DataFrame:
    """Seeds from strings or ``{url}`` structs, with a validity flag.

    A string may itself be a JSON object with a ``url`` field, the shape that
    mixed lists have when they are read as text.
    """
    if isinstance(raw.schema[column].dataType, T.StructType):
        url: Column = F.col(f"{column}.url")
    else:
        c = F.col(column)
        url = F.when(c.startswith("{"), F.get_json_object(c, "$.url")).otherwise(c)
    return raw.select(url.alias("url")).select("url", urls.is_http_url("url").alias("valid"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds from a text file, one string or ``{"url": ...}`` object per line."""
    return seed_urls(spark.read.text(path).withColumnRenamed("value", "seed"))


def seeds_from(spark: SparkSession, items: Iterable[str | dict]) -> DataFrame:
    """Seeds from a driver-side list; every entry must be an http(s) URL."""
    rows = []
    for i, item in enumerate(items):
        url = item if isinstance(item, str) else (item or {}).get("url")
        if not isinstance(url, str):
            raise ValueError(f"seed {i} must be a URL or hold a 'url' field")
        rows.append((url,))
    if not rows:
        raise ValueError("at least one seed is required")
    df = spark.createDataFrame(rows, SEED_SCHEMA)
    bad = df.where(~urls.is_http_url("url")).limit(1).collect()
    if bad:
        raise ValueError(f"seed is not an http(s) URL: {bad[0].url}")
    return df
