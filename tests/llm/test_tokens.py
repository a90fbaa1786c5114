"""Token files and packing."""

import random

import numpy as np
import pytest
from brute import crc, tokenizer
from pagewright.llm.ids import Encoder, default_path
from pagewright.llm.packing import CAPACITY, pack, pack_documents, pieces_of, plan
from pagewright.llm.token_files import read_token_files, write_token_files
from pagewright.session import work_dir

TEXTS = [
    "Plain text, with 12 numbers and it's marks!!", "", None, "  \n\t ", "ÀÉÎ über 中文 テスト é İstanbul ΣΑΣ", "a <|endoftext|> b <|startoftext|>",
    "don't they'll 'sup ''s x'd", " nbsp em\x1cfs", "word " * 9000, "x" * 5000, "🙂🙂 ½ ² ª º µ ß ÿ", "Same text.", "Same text.",
]


def rows():
    return [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(1, "again one"), (1, "again one")]


@pytest.mark.parametrize("cache", [600, 100_000_000])
def test_word_caches_change_nothing(cache):
    enc, plain = Encoder(default_path(), cache), tokenizer()
    rng = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices("abc ÉÜß'’.,!?12\n é世|<>", k=60)) for _ in range(300)]
    for i in range(0, len(texts), 40):
        got = enc.encode([t.encode() for t in texts[i : i + 40]])
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts[i : i + 40]]
        assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == want


def test_all_low_characters_are_counted_as_by_the_tokenizer():
    """Among them U+001C to U+001F, which are white space to str and not to bytes or the tokenizer."""
    enc, plain = Encoder(default_path()), tokenizer()
    low = [chr(c) for c in range(256)]
    texts = low + [f"a{c}b" for c in low] + [f"1{c}{d}z" for c in low[:128] for d in low[:128]] + ["".join(low)]
    for t, got in zip(texts, enc.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, enc.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, ascii(t)


def test_token_files_round_trip(spark, documents):
    path, plain = work_dir(spark, "test-tokens"), tokenizer()
    write_token_files(documents(rows()), path)
    got = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows()), key=lambda d: (d is not None, d))
    want = sorted((d is not None, d or 0, plain.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), crc(r.ids))
        start += r.n_tokens
    few = read_token_files(spark, path, with_ids=True, doc_ids=[1, 8, 99]).collect()
    assert sorted((r.doc_id, r.start) for r in few) == sorted((r.doc_id, r.start) for r in got if r.doc_id in (1, 8))


def test_token_files_of_nothing(spark, documents):
    path = work_dir(spark, "test-tokens")
    write_token_files(documents([]), path)
    assert read_token_files(spark, path).count() == 0


def check_packed(got, capacity):
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack_documents(documents):
    plain = tokenizer()
    got = pack_documents(documents(rows()), with_ids=True).collect()
    check_packed(got, CAPACITY)
    whole = []
    for d, t in rows():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        whole += [(d is None, d or 0, k, i, crc(ids[i : i + CAPACITY])) for k, i in enumerate(range(0, len(ids), CAPACITY))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.ids_crc32) for r in got) == sorted(whole)
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in got)


def test_pack_nothing_and_bad_lengths(spark, documents):
    assert pack(pieces_of(documents([]))).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        pack(spark.createDataFrame([(1, 0)], "id long, length long"), 10)


def test_pack_hot_length(spark):
    """One length holds most rows; ranks of many groups fit together."""
    pieces = spark.range(5000).selectExpr("id", "if(id % 10 < 8, 7L, 1 + id % 9) AS length")
    got = pack(pieces, 16).collect()
    assert len({r.id for r in got}) == 5000
    assert check_packed(got, 16) <= -(-sum(r.length for r in got) // 16) * 1.25


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_plan_places_each_piece_once_near_the_optimum():
    rng, worse = random.Random(8), 0
    for _ in range(400):
        capacity = rng.randint(5, 30)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = {n: items.count(n) for n in items}
        runs, bins = plan(counts, capacity)
        fill, ranks = {}, {}
        for n, first, many, each, start, place in runs:
            for x in range(many):
                fill.setdefault(start + x // each, []).append((place + x % each * n, n))
                ranks.setdefault(n, []).append(first + x)
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        assert sorted(fill) == list(range(bins))
        for found in fill.values():
            at = 0
            for place, n in sorted(found):
                assert place == at
                at += n
            assert at <= capacity
        worse += bins > optimum(items, capacity)
    assert worse <= 4


def test_plan_size_does_not_follow_the_corpus():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in range(1, 1001)}
    small, large = plan(counts, 1000)[0], plan({n: c * 10_000 for n, c in counts.items()}, 1000)[0]
    assert len(large) < 5 * 1000 and len(small) < 5 * 1000
