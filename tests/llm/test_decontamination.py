"""The FM-index and benchmark decontamination."""

import random

import numpy as np
import pytest
from brute import contamination
from pagewright.llm.decontamination import decontaminate, find_contamination, merge_spans
from pagewright.llm.fm_index import FMIndex, suffix_array

WORDS = "the a of cat dog runs über éa x1 over hill far near".split()


def corpus():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 5, 13, 14, 30])))) for i in range(8) if i != 2]
    items += [(2, "Cat; DOG"), (2, "cat dog runs"), (None, "hill far near hill"), (50, None), (51, ""), (52, " .,; ")]
    docs = [(1, None), (2, ""), (3, " ,.; "), (None, "cat dog")]
    for i in range(4, 60):
        words = rng.choices([*WORDS, "qq", "ww", "zz", "Cat", "DOG"], k=rng.randint(1, 80))
        for _ in range(rng.randint(0, 2)):
            source = rng.choice([t for _, t in items if t])
            words[rng.randrange(len(words)) : 0] = source.split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs + [docs[7], docs[7]], items


@pytest.mark.parametrize("settings", [{}, {"shard_words": 40}, {"block_chars": 60, "shard_words": 100}])
def test_against_brute_force(spark, documents, settings):
    docs, items = corpus()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    got = find_contamination(documents(docs), benchmark, **settings).collect()
    want = [(d, *contamination(t, items)) for d, t in docs]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert sum(s.end - s.first for s in r.spans) == r.n_hit
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:]))


def test_filter_keeps_clean_rows_as_they_are(spark, documents):
    docs, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = documents(docs)
    kept = decontaminate(table, benchmark)
    assert kept.columns == table.columns
    want = []
    for d, t in docs:
        n, hit, _ = contamination(t, items)
        if not (hit and 20 * hit >= n):
            want.append((d, t))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=key) == sorted(want, key=key)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_contamination(documents([]), one).count() == 0
    assert [r.n_hit for r in find_contamination(documents([(1, "a b")]), none).collect()] == [0]


def test_fm_index_against_search():
    rng = random.Random(1)
    for round_ in range(150):
        n, symbols = rng.randint(0, 60), rng.choice([3, 4, 9, 600])
        text = [rng.randint(1, symbols - 1) for _ in range(n)]
        if round_ % 3 == 0:
            text = text[: max(1, n // 6)] * 6
        ended = [*text, 0]
        assert suffix_array(np.array(ended), symbols).tolist() == sorted(range(len(ended)), key=lambda i: ended[i:])
        index = FMIndex(np.array(text, np.int64), symbols, every=rng.choice([1, 3, 16]))
        patterns = [[rng.randint(1, symbols - 1) for _ in range(rng.randint(1, 4))] for _ in range(8)]
        matrix = np.zeros((8, 4), np.int64)
        for i, p in enumerate(patterns):
            matrix[i, 4 - len(p) :] = p
        low, high = index.ranges(matrix, np.array(list(map(len, patterns))))
        for p, a, b in zip(patterns, low, high):
            places = sorted(index.locate(np.arange(a, max(a, b))).tolist())
            assert places == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]


def test_merge_spans():
    assert merge_spans([(5, 8), (0, 2), (2, 3), (6, 7), (20, 21)]) == [(0, 3), (5, 8), (20, 21)]


def test_blocks_are_bounded_however_often_an_item_is_repeated(spark):
    from pagewright.llm.decontamination import _blocks

    same = spark.range(20_000).selectExpr("1L AS item_id", "repeat('word ', 40) AS text")
    (one,) = _blocks(same, 13, 1000)
    many = spark.range(500).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(1, 30), x -> concat('w', id, '_', x))) AS text").union(same)
    blocks = _blocks(many, 13, 20_000)
    # About 115,000 different characters in blocks of 20,000 to 25,000.
    assert 4 <= len(blocks) <= 7
    assert _blocks(same.limit(0), 13, 1000)
