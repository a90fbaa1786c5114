"""The pipeline's stages, each against brute force on what the stage before has kept; and the queries."""

from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from brute import components, contamination, crc, tokenizer
from check import compare
from pagewright.llm.quality import score_documents, train
from pagewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    message, _, ok = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        assert k == 3 or docs.columns == columns
    source = spark.read.parquet(f"{SF}/documents.parquet")
    scored = score_documents(source, train(source, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    good, single, clean, packed = kept
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in scored if r.predicted)
    assert 0 < len(good) < source.count()
    want = [d for d, _, least in components([(r.doc_id, r.text) for r in good]) if d == least]
    assert sorted(r.doc_id for r in single) == sorted(want)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = {r.doc_id: contamination(r.text, items) for r in single}
    assert sorted(r.doc_id for r in clean) == sorted(d for d, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))
    plain, pieces = tokenizer(), []
    for r in clean:
        ids = plain.encode(r.text, add_special_tokens=False).ids + [1]
        pieces += [(r.doc_id, i // 4096, i, crc(ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.ids_crc32) for r in packed) == sorted(pieces)
    fill = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in found) <= 4096 for found in fill.values())
    total = sum(r.length for r in packed)
    assert len(fill) <= total // 4096 + 2
