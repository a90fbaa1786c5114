"""Links of stored pages, and the frontier reached from seeds over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html as H
from ..functions import urls as U
from ..session import cut_lineage
from .seen import build_filter, merge_filters, parts_for, unseen
from .keyed import HOT_KEYS

HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
NOT_LINKS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"

#: Links of one of the heaviest sources are spread over this many join keys.
SOURCE_SALTS = 64

#: Glob tables up to this many rows are compiled on the driver.
GLOBS_ON_DRIVER = 10_000


def page_links(pages: DataFrame) -> DataFrame:
    """Every ``a[href]`` of a page in order, resolved against the page and normalised."""
    hrefs = F.regexp_extract_all(F.regexp_replace("html", NOT_LINKS, ""), F.lit(HREF), F.lit(1))
    rows = pages.select(
        F.col("page_id").alias("src_page_id"), F.col("url").alias("src_url"),
        F.posexplode_outer(hrefs).alias("pos", "_raw"),
    ).where(F.col("_raw").isNotNull())
    href = H.decode_entities(F.regexp_replace("_raw", "^[\"']|[\"']$", ""))
    return (
        rows.withColumn("href", href)
        .withColumn("_abs", U.absolute("href", "src_url"))
        .select("src_page_id", "src_url", "pos", "href", U.normalize("_abs").alias("dst_url"))
    )


#: Links from which a frontier keeps a filter of the URLs it has seen.
FILTER_ABOVE = 1_000_000


def visit_once(urls: DataFrame, url: str = "url", depth: str = "depth") -> DataFrame:
    """Each normalised URL once, with the smallest depth it was seen at."""
    return (
        urls.select(U.normalize(url).alias("url"), F.col(depth).alias("depth"))
        .groupBy("url")
        .agg(F.min("depth").alias("depth"))
    )


def page_budget(frontier: DataFrame, max_pages: int | None) -> DataFrame:
    """The first ``max_pages`` URLs, shallow ones first; all of them without a budget."""
    return frontier if max_pages is None else frontier.orderBy("depth", "url").limit(max_pages)


def unvisited(candidates: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    return candidates.join(visited.select(url), url, "left_anti")


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("n"))


def expand_frontier(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int = 2,
    include: Sequence[str] = ("**",),
    exclude: Sequence[str] = (),
    allow: Column | None = None,
    filter_above: int = FILTER_ABOVE,
) -> DataFrame:
    """URLs reached from ``seeds`` (url) over ``links`` (src_url, dst_url).

    Each hop adds one to the depth. A URL is decided the first time it is reached,
    and followed if that decision is ``allowed``. ``allow`` is an extra predicate
    on ``url``; links that fail it are dropped. Returns (url, depth, parent, decision).

    Links are deduplicated and laid out by source once. The heaviest sources are
    salted, and their few frontier rows repeated per salt, so that a page with a
    third of all links is not joined in one task. Every hop is checkpointed.

    In a graph of more than ``filter_above`` links, what a hop finds is first held against a Bloom filter of all URLs seen,
    so that only those it may have seen are anti-joined with them; the rows are the same.
    """
    pairs = links.where(F.col("dst_url").isNotNull()).select(
        U.normalize("src_url").alias("src_url"), U.normalize("dst_url").alias("url")
    ).distinct()
    heavy = cut_lineage(
        pairs.groupBy("src_url").agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "src_url").limit(HOT_KEYS)
        .select("src_url", F.lit(True).alias("heavy"))
    )
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("url"), F.lit(SOURCE_SALTS)).cast("int")).otherwise(0)
    edges = cut_lineage(
        pairs.join(F.broadcast(heavy), "src_url", "left")
        .select("src_url", salt.alias("salt"), "url")
        .repartition("src_url", "salt")
    )
    salts = F.when(
        F.col("heavy"), F.sequence(F.lit(0), F.lit(SOURCE_SALTS - 1))
    ).otherwise(F.array(F.lit(0)))

    start = seeds.select(U.normalize("url").alias("url")).distinct().select(
        "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"),
        F.lit("allowed").alias("decision"),
    )
    seen = layer = cut_lineage(start)
    links_of_all = edges.count()
    parts = parts_for(links_of_all) if links_of_all > filter_above else 0
    bits = cut_lineage(build_filter(layer, "url", parts)) if parts else None
    for depth in range(1, max_depth + 1):
        sources = (
            layer.where(F.col("decision") == "allowed")
            .select(F.col("url").alias("src_url"))
            .join(F.broadcast(heavy), "src_url", "left")
            .select("src_url", F.explode(salts).alias("salt"))
        )
        reached = edges.join(sources, ["src_url", "salt"])
        if allow is not None:
            reached = reached.where(allow)
        found = reached.groupBy("url").agg(F.min("src_url").alias("parent"))
        new = unseen(found, seen, bits, "url", parts) if parts else unvisited(found, seen)
        decided = new.select(
            "url", F.lit(depth).alias("depth"), "parent",
            U.admission("url", F.lit(depth), max_depth, include, exclude).alias("decision"),
        )
        layer = cut_lineage(decided)
        if layer.isEmpty():
            break
        seen = seen.unionByName(layer)  # layers are kept; nothing is written twice
        if parts and depth < max_depth:
            bits = cut_lineage(merge_filters(bits, build_filter(layer, "url", parts)))
    return seen


def filter_by_globs(urls: DataFrame, globs: DataFrame, keep_matches: bool = True, url: str = "url") -> DataFrame:
    """Rows whose URL matches any (or no) pattern of a glob table (pattern).

    A table of at most ``GLOBS_ON_DRIVER`` patterns becomes literal patterns in the
    plan. A larger one is split: patterns with a literal host are joined by host,
    which keeps the comparison among few, and the others must fit that bound.
    """
    head = [r.pattern for r in globs.select("pattern").limit(GLOBS_ON_DRIVER + 1).collect()]
    if len(head) <= GLOBS_ON_DRIVER:
        hit = U.matches_any_glob(url, head)
        return urls.where(hit if keep_matches else ~hit)
    to_regex = F.udf(U.glob_to_regex, T.StringType(), useArrow=False)
    literal_host = F.nullif(F.regexp_extract("pattern", r"^https?://([^/*?{}\[\]]+)(?:/.*)?$", 1), F.lit(""))
    keyed = globs.select("pattern", F.lower(literal_host).alias("_host"))
    free = [
        r.pattern for r in keyed.where(F.col("_host").isNull()).limit(GLOBS_ON_DRIVER + 1).collect()
    ]
    if len(free) > GLOBS_ON_DRIVER:
        raise ValueError(f"more than {GLOBS_ON_DRIVER} patterns without a literal host")
    by_host = keyed.where(F.col("_host").isNotNull()).select(
        "_host", to_regex("pattern").alias("_regex")
    ).distinct()
    # One host may hold a third of the URLs: its rows are salted, its patterns repeated.
    by_host = by_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SOURCE_SALTS - 1))))
    u = urls.withColumns(
        {
            "_host": U.host(url),
            "_free": U.matches_any_glob(url, free),
            "_salt": F.pmod(F.xxhash64(url), F.lit(SOURCE_SALTS)).cast("int"),
        }
    )
    match = (
        (F.col("u._host") == F.col("g._host"))
        & (F.col("u._salt") == F.col("g._salt"))
        & F.expr(f"u.`{url}` RLIKE g._regex")
    )
    rest = u.where(~F.col("_free")).alias("u")
    if keep_matches:
        out = u.where("_free").unionByName(rest.join(by_host.alias("g"), match, "left_semi"))
    else:
        out = rest.join(by_host.alias("g"), match, "left_anti")
    return out.select(*urls.columns)
