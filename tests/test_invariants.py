"""Checks of chunks move numbers, not the text of documents."""

import __spark_entry__ as E


def test_no_text_is_aggregated(spark, tmp_path):
    texts = ["one line\nof text " * 200, "x", "", None]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = E.queries()["chunk_split_invariants"](spark, str(tmp_path))
    # A buffer that holds text is sorted, with the text, by key; numbers are aggregated by hash.
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert {r.doc_id for r in rows} == {0, 1, 2} and all(r.fits and r.dense and r.in_order and r.complete for r in rows)
