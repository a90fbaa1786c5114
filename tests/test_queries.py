"""Registered queries against their DuckDB twins on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from check import compare

SF = "/root/testdata/sf0.001"
SLOW = ("page_", "stream_page", "link_frontier_", "fallback_content")
#: Queries of the pipeline package have their own tests.
OTHERS = re.compile(r"op\d+_|pipeline$")
NAMES = [n for n in E.queries() if not OTHERS.match(n) and (not n.startswith(SLOW) or n in ("page_gates", "page_links", "page_record_totals"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    message, _, ok = compare(spark, duck, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert ok, message


def test_contract(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 90
    assert E.entry(spark).count() == 50
