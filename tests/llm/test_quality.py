"""The compression classifier."""

import zlib

from pagewright.llm.quality import keep_good, score_documents, train

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = score_documents(documents, train(documents, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.98
    assert sum(r.predicted for r in held if r.quality == 1) / sum(r.quality for r in held) > 0.99


def test_held_out_labels_are_not_read(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    assert train(documents, labels) == train(documents, turned)


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "a"), (3, "b"), (4, "long text " * 200_000)]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    table = documents(rows)
    got = score_documents(table, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {model.prior}
    kept = keep_good(table, model)
    assert kept.columns == table.columns and kept.schema["doc_id"].dataType == table.schema["doc_id"].dataType
    assert kept.count() == sum(r.predicted for r in got)


def test_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bad = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 7, 0), (6, 1, 0), (6, 1, 0)], none.schema)
    for labels in (none, bad):
        table = documents([(1, "a"), (6, "b")])
        assert [r.score for r in score_documents(table, train(table, labels)).collect()] == [0.5, 0.5]
        assert score_documents(documents([]), train(documents([]), labels)).count() == 0
