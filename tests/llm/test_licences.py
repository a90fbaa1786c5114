"""The licence classifier."""

import random

import pytest
from pagewright.llm.licences import TEMPLATES, scan, train
from pyspark.sql import functions as F

NOISE = ["the of and that not in to", "Reanth ouble eresh.", "This work is large and free to see.", "The The The The", "Version 2.0 of the file", "license"]


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_notices_are_found_and_confirmed(documents, model):
    rng, rows, want = random.Random(3), [], set()
    for i, (family, template) in enumerate((f, t) for f, found in TEMPLATES.items() for t in found):
        lines = rng.sample(NOISE, 3)
        at = rng.randrange(4)
        rows.append((i, "\n".join([*lines[:at], template.upper() if i % 3 == 0 else template, *lines[at:]])))
        want.add((i, at, family))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "All rights reserved."), (0, "All rights reserved."), (103, "word " * 50_000)]
    got = scan(documents(rows), model).where("confirmed").collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == want | {(None, 0, "All rights reserved"), (0, 0, "All rights reserved")}
    assert all(0.3 < r.probability <= 1 for r in got)


def test_all_notices_of_the_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    true = lines.where("line rlike '(?i)licensed under|MIT License|all rights reserved'").select("doc_id", "paragraph").collect()
    found = scan(docs, model).where("confirmed").select("doc_id", "paragraph").collect()
    assert set(map(tuple, found)) == set(map(tuple, true)) and true


def test_empty_table(documents, model):
    assert scan(documents([]), model).count() == 0
    assert train(documents([])).classes[-1] == "unknown"
