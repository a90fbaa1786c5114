"""Runs without a budget, and statistics taken while records are written."""

from pagewright.params import PageJobParams, ParameterError
from pagewright.plans.crawl import crawl
from pagewright.plans.pages import page_results
from pagewright.sources import sinks

import pytest

TEXT = "A sentence of some words, and another. " * 40


def page(i, *links):
    hrefs = "".join(f'<a href="{u}">x</a>' for u in links)
    return (i, f"http://s.org/{i}", f"<html><head><title>T{i}</title></head><body><nav>{hrefs}</nav><article><p>{i} {TEXT}</p></article></body></html>")


def test_run_without_a_budget_keeps_every_reachable_page(spark):
    rows = [page(i, f"/{2 * i + 1}", f"/{2 * i + 2}") for i in range(40)] + [page(100)] + [page(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("http://s.org/0",)], "url string")
    got = crawl(seeds, pages, PageJobParams(crawl_depth=10, max_pages=None)).collect()
    assert sorted(r.title for r in got) == sorted([f"T{i}" for i in range(40)] + ["T3"])
    assert all(r.status == "success" and r.chunks[0].content.startswith(r.title[1:]) for r in got)
    few = crawl(seeds, pages, PageJobParams(crawl_depth=10, max_pages=3)).collect()
    assert sorted(r.title for r in few) == ["T0", "T1", "T2"]


def test_budget_range():
    assert PageJobParams(max_pages=None).max_pages is None
    with pytest.raises(ParameterError):
        PageJobParams(max_pages=0)


def test_write_run_reads_its_input_once(spark, tmp_path):
    rows = [page(i) for i in range(6)] + [(9, "http://s.org/x", "<p>tiny</p>")]
    results = page_results(spark.createDataFrame(rows, "page_id long, url string, html string"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    counted = results.mapInArrow(count, results.schema)
    (totals,) = sinks.write_run(counted, f"{tmp_path}/run").collect()
    assert read.value == 7
    assert (totals.total_requests, totals.successful_requests, totals.failed_extractions, totals.success_rate) == (7, 6, 1, 86)
    records = spark.read.parquet(f"{tmp_path}/run/records")
    assert records.count() == 7 and records.where("status = 'extraction_failed'").count() == 1
    (stored,) = spark.read.json(f"{tmp_path}/run/statistics").collect()
    assert stored.asDict() == totals.asDict()


def test_write_run_of_nothing(spark, tmp_path):
    results = page_results(spark.createDataFrame([], "page_id long, url string, html string"))
    (totals,) = sinks.write_run(results, f"{tmp_path}/run").collect()
    assert totals.total_requests == 0 and totals.success_rate == 0 and totals.total_chunks == 0
