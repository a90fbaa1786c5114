"""A run from seeds over stored pages."""

from pagewright.params import PageJobParams
from pagewright.plans.crawl import visited_pages, visited_urls

TEXT = "A sentence of some words, and another. " * 40


def page(i, *links):
    hrefs = "".join(f'<a href="{u}">x</a>' for u in links)
    return (i, f"http://s.org/{i}", f"<html><head><title>T{i}</title></head><body><nav>{hrefs}</nav><article><p>{TEXT}</p></article></body></html>")


def test_run_follows_links_within_depth_globs_and_budget(spark):
    rows = [page(0, "/1", "/2.pdf", "http://other.org/x"), page(1, "/2", "#top"), page(2, "/3"), page(3), page(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://s.org/0#a",)], "url string")

    # A URL is followed if it is reached below the depth limit.
    visited = visited_urls(seeds, pages, PageJobParams(crawl_depth=3, max_pages=3)).collect()
    assert [r.url for r in visited] == ["http://s.org/0", "http://other.org/x", "http://s.org/1"]
    stored = visited_pages(spark.createDataFrame([(r.url,) for r in visited], "url string"), pages).collect()
    assert sorted(r.page_id for r in stored) == [0, 1]
    reached = {r.url for r in visited_urls(seeds, pages, PageJobParams(crawl_depth=3)).collect()}
    assert reached == {"http://s.org/0", "http://s.org/1", "http://s.org/2", "http://other.org/x"}
