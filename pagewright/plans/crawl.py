"""From seeds to page records over stored pages: frontier, globs, depth, budget, page job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.links import expand_frontier, page_budget, page_links
from ..params import PageJobParams
from ..session import cut_lineage
from .pages import page_results


def visited_urls(
    seeds: DataFrame,
    pages: DataFrame,
    params: PageJobParams | None = None,
    links: DataFrame | None = None,
    exclude: Sequence[str] = U.EXCLUDED_GLOBS,
    allow: Column | None = None,
) -> DataFrame:
    """The URLs (url, depth, parent) a run visits: reached from ``seeds`` (url) within ``crawl_depth``, let through
    by the globs, shallow ones first up to ``max_pages``.

    ``links`` (src_url, dst_url) are those of the pages themselves unless given.
    """
    p = params or PageJobParams()
    if links is None:
        # Kept: normal forms of normal forms, merged into one plan, would be very large expressions.
        links = cut_lineage(page_links(pages).select("src_url", "dst_url"))
    reached = expand_frontier(seeds, links, p.crawl_depth, p.include_globs or ("**",), exclude, allow)
    return page_budget(reached.where(F.col("decision") == "allowed").select("url", "depth", "parent"), p.max_pages)


def visited_pages(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored pages (page_id, url, html) of visited URLs. URLs are compared in normal form; every stored
    version of a URL counts."""
    wanted = visited.select(F.col("url").alias("_url"))
    return pages.withColumn("_url", U.normalize("url")).join(wanted, "_url", "left_semi").select("page_id", "url", "html")


def crawl(seeds: DataFrame, pages: DataFrame, params: PageJobParams | None = None, crawled_at: Column | None = None, **frontier) -> DataFrame:
    """Page records of a run from ``seeds`` over stored ``pages``; options as in :func:`visited_urls`."""
    p = params or PageJobParams()
    return page_results(visited_pages(visited_urls(seeds, pages, p, **frontier), pages), p, crawled_at)
