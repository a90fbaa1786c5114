"""Levelled runs of line hashes against a plain count of lines."""

import random

import duckdb
import pytest
from brute import dedup_lines as brute

from pagewright.llm import line_dedup as L
from pagewright.llm.queries import ORACLES, QUERIES
from pagewright.session import work_dir

SF = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(ORACLES["op11_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op11_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == want and any(r[2] for r in got)


@pytest.mark.parametrize("batches", [1, 4, 11])
def test_against_brute_force(spark, documents, batches):
    r = random.Random(batches)
    pool = ["Menu", " menu\t", "MENU ", "", " ", "é", "É", "one\x0b", "\x1cx", "x", " ", "long " * 3000] + [f"l{i}" for i in range(40)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(None, None), (None, "menu\nown line"), (3, "menu"), (3, "menu"), (4, ""), (5, "\n\n"), (6, "x\n" * 5000)]
    got = L.dedup_lines(documents(rows), min_docs=7, batches=batches)
    want = brute([t for _, t in rows], 7)
    assert sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped, r.key) for r in got.collect()) == sorted(
        (d or -1, *w, "x") for (d, _), w in zip(rows, want)
    )


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("a\nb", 7, "r", 1.5), ("a", 8, None, None)], "text string, n_lines int, row string, `a.b` double")
    got = {r.n_lines: r for r in L.dedup_lines(docs, min_docs=2).collect()}
    assert got[2].text == "b" and got[2].row == "r" and got[2]["a.b"] == 1.5
    assert got[1].text == "" and got[1].n_dropped == 1
    assert L.dedup_lines(docs.limit(0)).collect() == []


def test_many_equal_rows(spark):
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('same\nlines') AS text").union(spark.range(3).selectExpr("id", "'other' AS text"))
    got = L.dedup_lines(docs).groupBy("doc_id", "text", "n_dropped").count().collect()
    assert sorted((r.doc_id, r.text, r.n_dropped, r["count"]) for r in got) == [(0, "other", 0, 1), (1, "", 2, 5000), (1, "other", 0, 1), (2, "other", 0, 1)]


def test_store_levels_repeats_and_opens_again(spark):
    def keys(*pairs):
        return spark.createDataFrame([(a, a) for a in pairs], "h1 long, h2 long")

    folder = work_dir(spark, "runs")
    runs = L.LineRuns(spark, folder, min_docs=3, fanout=2)
    runs.add("a", keys(1, 1, 2, 3))
    assert [len(x) for x in runs.levels] == [1]
    runs.add("b", keys(1, 2, 4))
    assert [len(x) for x in runs.levels] == [0, 1]
    runs.add("b", keys(2, 2, 2))  # a batch that is repeated adds nothing
    again = L.LineRuns.open(spark, folder, min_docs=3, fanout=2)
    assert again.levels == runs.levels and again.batches == ["a", "b"]
    again.add("c", keys(1, 1, 2, 5))
    assert {r.h1 for r in again.repeated().collect()} == {1, 2}
    # Key 1 was repeated before batch c, so the new run does not hold it.
    assert {r.h1 for r in spark.table(again.levels[0][0]).collect()} == {2, 5}
    assert {r.h1 for r in again.unseen(keys(1, 5, 6)).collect()} == {5, 6}


def test_runs_are_joined_where_they_lie(spark):
    runs = L.LineRuns(spark, work_dir(spark, "runs"), fanout=9)
    some = spark.range(100).selectExpr("id AS h1", "id AS h2")
    for b in "ab":
        runs.add(b, some)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs._merged(runs.levels[0])._jdf.queryExecution().executedPlan().toString()
        joined = runs.unseen(some)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count("Exchange") == 1 and "SortMergeJoin" in joined  # of the batch only
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert "Python" not in plan + joined


def test_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = L.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
