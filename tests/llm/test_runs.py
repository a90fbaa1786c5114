"""Runs from Lyndon roots against comparing every place with every period."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import runs as R
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def lyndon_by_hand(word):
    def lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    return [max(k for k in range(1, len(word) - i + 1) if lyndon(word[i : i + k])) for i in range(len(word))]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_lyndon_lengths(word):
    ranks = np.unique(word, return_inverse=True)[1].tolist()
    assert R.lyndon_lengths(ranks) == lyndon_by_hand(word)


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.sampled_from([(2, 2), (5, 2), (6, 3), (9, 4)]))
@settings(max_examples=300, deadline=None)
def test_runs_of_words(texts, least):
    words = [[b"%d" % x for x in t] for t in texts]
    got = [[tuple(r) for r in a.tolist()] for a in R.runs_of_words(words, *least)]
    assert got == [brute.runs(w, *least) for w in words]


def test_runs_of_special_words():
    r = random.Random(3)
    texts = [fibonacci(150), [0] * 90, [0, 1] * 60 + [2] + [1, 0] * 40, list(range(7)) * 9 + list(range(5)) * 9]
    texts += [[r.randrange(3) for _ in range(9)] * 8 + [r.randrange(40) for _ in range(60)] for _ in range(20)]
    words = [[b"%d" % x for x in t] for t in texts]
    for least in ((24, 3), (2, 2), (10, 3)):
        got = [[tuple(x) for x in a.tolist()] for a in R.runs_of_words(words, *least)]
        assert got == [brute.runs(w, *least) for w in words]


def test_narrowing_is_lossless():
    for length, exponent in ((24, 3), (5, 3), (30, 5), (10, 2)):
        width = R.narrowing(length, exponent)
        assert width >= 1
        assert all(max(length, exponent * q) - width + 1 >= 2 * q for q in range(1, 200))
    assert R.narrowing(24, 3) == 9


def test_long_text_takes_linear_time():
    line = [b"w%d" % i for i in range(11)]
    words = line * 20_000
    (got,) = R.runs_of_words([words])
    assert got.tolist() == [[0, 220_000, 11]]
    assert R.collapsed(words, got) == b" ".join(line)


@pytest.fixture(scope="module")
def table():
    r = random.Random(1)
    rows = [(None, None), (1, ""), (2, None), (3, " \t\n"), (3, " \t\n"), (20, "one")]
    for k in range(150):
        some = [f"w{r.randrange(30)}" for _ in range(r.randrange(1, 60))]
        rows.append((k, r.choice([" ", "\n", "  \x0b"]).join(some * r.choice([1, 1, 2, 5]))))
    rows += [(k, "\xa0é\x1c b\u2028 " * 12) for k in (7, 7, 8)]
    return rows


def test_query_rows(spark, documents, table, tmp_path):
    documents(table).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    want = [(d, *brute.run_row(d, t)) for d, t in table if d is not None]
    key = lambda row: tuple(-1 if x is None else x for x in row)
    assert sorted((tuple(x[c] for c in ["doc_id", *COLUMNS]) for x in got if x.doc_id is not None), key=key) == sorted(want, key=key)
    assert [x.n_runs for x in got if x.doc_id is None] == [0]


def test_smallest_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got.keys() == docs.keys() and sum(r[0] > 0 for r in got.values()) > 5
    short = [d for d, t in docs.items() if len(t or "") < 6000]
    assert len(short) > 100
    for d in short:
        assert got[d] == brute.run_row(d, docs[d]), d


def test_columns_pass_through_and_empty(spark, documents):
    docs = documents([(1, "a b " * 20)])
    (row,) = R.find_runs(docs).collect()
    assert row["_0"] == 1 and row["_5"] == "x" and row.collapsed == "a b" and row.n_words == 40
    assert R.find_runs(docs.limit(0)).collect() == []
