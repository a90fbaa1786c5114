"""Counts by pieces and the store of counts against the tokenizer on whole texts."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions.tokens import count_tokens_of
from pagewright.operators import keyed
from pagewright.operators import pieces as P
from pagewright.session import work_dir

SPECIAL = ["", " ", "  ", "\n\n x", "it's we'll I'D", "a b c", "x" * 2000, "1234567 12a", "…—!? !!", "é́ ñ 漢字 😀😀", "\x1c\x1f\x0b", "\u0085", "tab\t\tend \n"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(0)
    alphabet = "ab é1 \n\t'.  漢😀"
    texts = SPECIAL + ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(300)] + [None, "same"] * 20
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")


def test_counts_equal_those_of_whole_texts(rows):
    for r in P.count_by_pieces(rows, ["id"]).collect():
        assert r.tokens == count_tokens_of(r.content or ""), repr(r.content)


@given(st.lists(st.text(max_size=30), min_size=20, max_size=40))
@settings(max_examples=3, deadline=None)
def test_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    assert {r.id: r.tokens for r in P.count_by_pieces(df, ["id"]).collect()} == {i: count_tokens_of(t) for i, t in enumerate(texts)}


def test_each_piece_is_encoded_once(spark):
    docs = spark.range(2000).selectExpr("concat('the same words again and again ', id % 3) AS text")
    known = P.piece_dictionary(docs).collect()
    assert len(known) == len({r.key for r in known}) == 8 and sum(r.n for r in known) == 2000 * 7


def test_empty_table(spark):
    assert P.count_by_pieces(spark.createDataFrame([], "id long, content string"), ["id"]).collect() == []


def written(spark, store, run):
    return {r.digest for r in spark.read.parquet(f"{store.folder}/run={run}").collect()}


def test_store_counts_a_text_once_over_runs(spark, rows):
    store = P.TokenStore(spark, work_dir(spark, "store"))
    first = store.count(rows, "a", ["id"]).collect()
    assert not any(r.reused for r in first)
    for r in first:
        assert r.tokens == count_tokens_of(r.content or "")
    more = rows.union(spark.createDataFrame([(9999, "new text")], "id long, content string"))
    second = store.count(more, "b", ["id"]).collect()
    assert {r.id for r in second if not r.reused and r.content is not None} == {9999}
    assert len(written(spark, store, "b")) == 1
    assert {r.id: r.tokens for r in second if r.id != 9999} == {r.id: r.tokens for r in first}
    third = store.count(more, "c", ["id"])
    assert written(spark, store, "c") == set() and third.where(~F.col("reused") & F.col("content").isNotNull()).count() == 0


def test_store_after_a_run_that_was_stopped(spark, rows):
    store = P.TokenStore(spark, work_dir(spark, "store"))
    few = rows.where("id < 20")
    # A run that dies while it writes leaves files that were not committed; nobody reads them.
    folder = f"{store.folder}/run=a/_temporary/0".removeprefix("file:")
    os.makedirs(folder)
    with open(f"{folder}/part-00000.parquet", "wb") as f:
        f.write(b"half")
    assert store.known().count() == 0
    one = store.count(few, "a", ["id"]).count()
    parts = written(spark, store, "a")
    # Repeated under its name it counts the same texts and replaces its part.
    assert store.count(few, "a", ["id"]).where("reused").count() == 0
    assert written(spark, store, "a") == parts and one == 20
    assert store.known().count() == len(parts)


def test_run_names(spark, rows):
    with pytest.raises(ValueError):
        P.TokenStore(spark, "/tmp/x").count(rows, "../a", ["id"])


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_rare_and_frequent_pieces(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT_PIECES", hot)
    twice = rows.union(rows.limit(100))
    got = P.count_by_pieces(twice, ["id"]).collect()
    assert len(got) == twice.count() and all(r.tokens == count_tokens_of(r.content or "") for r in got)


def test_places_of_pieces_do_not_move(spark, monkeypatch):
    moved = []

    def attach(df, *args):
        moved.append(df.count())
        return keyed.attach_by_key(df, *args)

    monkeypatch.setattr(P, "attach_by_key", attach)
    texts = spark.range(20).selectExpr("id", "concat(repeat('the same words ', 500), id) AS content")
    assert P.count_by_pieces(texts, ["id"]).where("tokens < 1500").count() == 0
    P.TokenStore(spark, work_dir(spark, "store")).count(texts, "a", ["id"]).count()
    assert moved and max(moved) <= 20
