"""The splitter as a SQL table function against the column step."""

import pytest
from pyspark.errors import AnalysisException

from pagewright.functions import table_functions
from pagewright.functions.lengths import LENGTHS, length_function
from pagewright.operators.chunking import chunk_documents

TEXTS = [
    (1, "One two three four five six.\r\n\r\n\r\n\r\n\r\n# Seven\nEight  nine ten eleven." * 4),
    (2, None), (3, " \t\n"), (4, "é😀 " * 50), (4, "é😀 " * 50), (None, "x" * 95), (5, "word"),
]


@pytest.fixture(scope="module")
def docs(spark):
    table_functions.register(spark)
    df = spark.createDataFrame(TEXTS, "doc_id long, body string").selectExpr("*", "array(doc_id) AS extra")
    df.createOrReplaceTempView("split_docs")
    return df


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("length", [*LENGTHS])
def test_equals_the_column_step(spark, docs, length):
    got = spark.sql(f"SELECT * FROM split_text(TABLE(SELECT * EXCEPT (body), clean_text(body) AS body FROM split_docs), 'body', 40, 8, length => '{length}')")
    assert got.columns == ["doc_id", "extra", "chunk_index", "total_chunks", "content", "length", "start_offset", "end_offset"]
    want = chunk_documents(docs, "body", 40, 8, length=length).select(got.columns)
    assert rows(got) == rows(want) and got.count() > 5


def test_separators_kept(spark, docs):
    got = spark.sql("SELECT doc_id, content FROM split_text(TABLE(split_docs), 'body', 30, 0, keep_separator => true, separators => array(' ', ''))")
    assert {r.content for r in got.collect() if r.doc_id == 5} == {"word"}
    assert all(len(r.content) <= 30 for r in got.collect())


@pytest.mark.parametrize(
    "arguments, message",
    [
        ("'text'", "no column"),
        ("'doc_id'", "not a string"),
        ("'body', 10, 10", "chunk_overlap < chunk_size"),
        ("'body', length => 'pages'", "unknown length function"),
        ("'body', separators => array()", "separators must not be empty"),
    ],
)
def test_wrong_arguments_fail_before_the_query_runs(spark, docs, arguments, message):
    with pytest.raises(AnalysisException, match=message):
        spark.sql(f"SELECT * FROM split_text(TABLE(split_docs), {arguments})")


def test_clashing_columns_are_refused(spark, docs):
    with pytest.raises(AnalysisException, match="rename the columns content"):
        spark.sql("SELECT * FROM split_text(TABLE(SELECT body, 1 AS content FROM split_docs), 'body')")


def test_rows_stay_where_they_are(spark, docs):
    plan = spark.sql("SELECT * FROM split_text(TABLE(split_docs), 'body')")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_length_function():
    assert length_function("utf16")("é😀") == 3 and length_function("utf8_bytes")("é😀") == 6
    assert length_function(len) is len
