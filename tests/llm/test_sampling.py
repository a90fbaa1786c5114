"""Bounded samples of tables whose ids say nothing."""

import pytest

from pagewright.llm.licences import train as train_licences
from pagewright.llm.main_text import BlockModel, train as train_pages
from pagewright.llm.sampling import drawn
from pagewright.llm.token_files import train_dictionary
from pagewright.llm.ids import default_path

LONG = "This is a sentence of the story, and it goes on for a while. Another one follows it here."


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS LONG)", "7L", "id"])
@pytest.mark.parametrize("text", ["concat('text ', id)", "'the same'"])
def test_ids_do_not_matter(spark, doc_id, text):
    rows = spark.range(100_000).selectExpr(f"{doc_id} AS doc_id", f"{text} AS text")
    got = drawn(rows, 400, "salt", of=100_000).collect()
    assert len(got) == 400
    if "id)" in text:
        assert len(set(got)) == 400
        assert sorted(got) == sorted(drawn(rows.repartition(5), 400, "salt", of=100_000).collect())


def test_base_may_be_wrong(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    assert drawn(rows, 100, "salt", of=10_000_000).count() == 100
    assert drawn(rows.limit(20), 100, "salt", of=10_000_000).count() == 20
    assert drawn(rows.limit(0), 100, "salt", of=0).count() == 0


def test_operators_train_where_all_ids_are_null(spark):
    docs = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('words of a text number ', id, ' and more, twice ', id * 7) AS text")
    assert len(train_dictionary(docs, default_path(), 2)) > 0
    assert (train_licences(docs).weights != 0).any()
    html = f"<nav><a href=/x>Home</a></nav><article><p>{LONG}</p></article>"
    pages = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS page_id", f"concat('{html}', id) AS html")
    assert (train_pages(pages).weights != BlockModel().weights).any()
