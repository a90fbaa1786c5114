"""The n-gram Jaccard join and its R-tree."""

import random

import numpy as np
import pytest
from brute import components as brute_components
from brute import shingles
from pyspark.sql import functions as F

from pagewright.llm import jaccard_join
from pagewright.llm.components import components
from pagewright.llm.jaccard_join import RTrees, bucket_keys, jaccard_components, keep_one_each, needed
from pagewright.llm.shingles import shingle_set


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n)]


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        text[rng.randrange(len(text))] = "".join(rng.choices("xyz", k=5))
    return text


def corpus(seed=5):
    rng = random.Random(seed)
    docs = [None, "", " \n ", "one", "ONE", "one two", "One  two", "one two three", "Three two one"]
    passage = words(rng, 60)
    for _ in range(14):
        base = words(rng, rng.choice([9, 11, 12, 30, 80, 300]))
        docs.append(" ".join(base))
        chain = base
        for _ in range(rng.randint(0, 6)):
            chain = edited(rng, chain, max(1, len(base) // 60))
            docs.append(rng.choice([" ", "\n\t"]).join(chain).upper())
    docs += [" ".join(passage + words(rng, rng.randint(1, 9))) for _ in range(12)]
    docs += [" ".join(words(rng, 40) + passage) for _ in range(6)] + docs[10:14]
    rng.shuffle(docs)
    return [(i * 3 % 1000 if i != 20 else None, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("page", [2048, 4])
def test_against_brute_force(spark, documents, monkeypatch, page):
    monkeypatch.setattr(jaccard_join, "PAGE", page)
    if page == 4:
        monkeypatch.setattr(jaccard_join, "BROADCAST_NAMES", 0)
    rows = corpus()
    rows += [rows[30], rows[30]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([tuple(r) for r in jaccard_components(documents(rows)).collect()], key=key)
    assert got == sorted(brute_components(rows), key=key)


def test_large_group_of_near_copies(spark, documents):
    """A star of near copies whose links cross the threshold both ways."""
    rng = random.Random(2)
    base = words(rng, 120)
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4])))) for i in range(150)]
    got = sorted(tuple(r) for r in jaccard_components(documents(rows)).collect())
    assert got == sorted(brute_components(rows))


def test_keep_one_each(documents):
    rows = [(5, "a b c d e"), (3, "A b c d  e"), (9, "z y x w"), (7, None), (8, ""), (None, "q r s t")]
    table = documents(rows)
    kept = keep_one_each(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 8, 9]


def test_keep_one_each_goes_by_rows(documents):
    """Rows that share a doc id, equal rows, and rows without a doc id."""
    first, own, third = "a b c d e", "k l m n o p", "q r s t u"
    rows = [(1, first), (5, first.upper()), (5, own), (6, third), (6, third), (6, third), (None, third), (None, "v w x y"), (None, "V w x y")]
    kept = keep_one_each(documents([*rows, (2, ""), (2, ""), (None, None)])).collect()
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept)
    assert got == [(0, ""), (0, "v w x y"), (1, first), (2, ""), (2, ""), (5, own), (6, third)]


def test_keep_one_each_against_brute_force(documents):
    rows = [(d if i % 7 else None, t) for i, (d, t) in enumerate(corpus(11))]
    rows += rows[5:25] + [(rows[3][0], t) for _, t in rows[30:36]]
    shingled = [shingles(t) for _, t in rows]
    kept = [(r.doc_id, r.text) for r in keep_one_each(documents(rows)).collect()]
    # Positions stand for doc ids, so that a component is a set of rows.
    label = [least for _, _, least in brute_components([(i, t) for i, (_, t) in enumerate(rows)])]
    want = {}
    for i, (d, _) in enumerate(rows):
        want.setdefault(label[i] if shingled[i] else (i,), []).append((d is None, d or 0))
    assert sorted((d is None, d or 0) for d, _ in kept) == sorted(min(found) for found in want.values())
    member = {}
    for i, r in enumerate(rows):
        if shingled[i]:
            member.setdefault(r, set()).add(label[i])
    assert len({frozenset(member[r]) for r in kept if shingles(r[1])}) == len({x for i, x in enumerate(label) if shingled[i]})


def test_empty_table(documents):
    assert jaccard_components(documents([])).count() == 0


def test_every_link_shares_a_bucket():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.choice([9, 10, 11, 13, 14, 19, 40, 137, 400])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), n - rng.randint(0, max(1, n // 18))))
        while 19 * len(a & b) >= 9 * (len(a) + len(b) + 1) and rng.random() < 0.9:
            b.add(rng.getrandbits(64))
        if 19 * len(a & b) >= 9 * (len(a) + len(b)):
            keys = [set(bucket_keys(np.array(sorted(x), np.uint64)).tolist()) for x in (a, b)]
            assert keys[0] & keys[1] or a == b


def test_r_trees_keep_all_pairs_over_the_bound():
    rng = np.random.default_rng(3)
    n = 400
    base = rng.poisson(2, (12, jaccard_join.DIMENSIONS))
    points = np.maximum(0, base[rng.integers(0, 12, n)] + rng.integers(-1, 2, (n, jaccard_join.DIMENSIONS)) * (rng.random((n, jaccard_join.DIMENSIONS)) < 0.08))
    points = points.astype(np.int32)
    size, bucket, comp = points.sum(1), np.sort(rng.integers(0, 5, n)), rng.integers(0, 30, n)
    side, cross = rng.integers(0, 2, n), rng.random(n) < 0
    trees = RTrees(bucket, side, size, comp, points)
    got = {tuple(sorted(p)) for a, b, _ in trees.pairs(cross) for p in zip(a.tolist(), b.tolist())}
    want = set()
    for i in range(n):
        for k in range(i):
            fit = 10 * min(size[i], size[k]) >= 9 * max(size[i], size[k])
            if bucket[i] == bucket[k] and comp[i] != comp[k] and fit and np.minimum(points[i], points[k]).sum() >= needed(size[i], size[k]):
                want.add((k, i))
    assert got == want and want


def near_copies(n, words=80, seed=5):
    """Texts that differ from one text in a word each: all link, through many buckets."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        mine = list(base)
        mine[rng.randrange(words)] = f"x{i}"
        out.append((i, " ".join(mine)))
    return out


@pytest.mark.parametrize("n", [60, 240])
def test_a_bucket_of_near_copies_gives_a_forest(spark, documents, n):
    """The pairs that leave the trees grow with the nodes, not with their square."""
    table = documents(near_copies(n))
    signed = jaccard_join.signatures(table).cache()
    members = signed.select("node", F.explode("keys").alias("key")).withColumn("comp", F.col("node"))
    sets = jaccard_join._sets(table, signed, signed.select("node"), 3)
    found = jaccard_join._bucket_pairs(members, sets).groupBy("key").count().agg(F.max("count"), F.sum("count")).first()
    sizes = members.groupBy("key").count().agg(F.max("count"), F.sum("count")).first()
    assert 0 < found[0] < sizes[0] and found[1] < sizes[1]
    signed.unpersist()
    assert {r.component_id for r in jaccard_components(table).collect()} == {0}


def test_forests_against_connected_pairs():
    """Joined in all forests means that at least as many pairs lead there; pairs that are refused count for nothing."""
    rng = np.random.default_rng(0)
    bucket, comp = np.repeat([0, 1], 30), np.arange(60) % 25
    a, b = rng.integers(0, 30, 400), rng.integers(0, 30, 400)
    keep = a != b
    a, b = a[keep], b[keep]
    for share in (1, 3, 100):
        forests = jaccard_join.Forests(bucket, comp, share)
        chosen = forests.take(a, b, np.ones(len(a)), lambda k: k % 5 == 0)
        assert all(k % 5 for k in chosen) and len(chosen) <= share * 29
        again = jaccard_join.Forests(bucket, comp, 1)
        again.take(a[chosen], b[chosen], np.ones(len(chosen)), lambda k: False)
        whole = jaccard_join.Forests(bucket, comp, 1)
        rest = np.flatnonzero(np.arange(len(a)) % 5)
        whole.take(a[rest], b[rest], np.ones(len(rest)), lambda k: False)
        assert np.array_equal(again.joined(), whole.joined())
    assert not set(whole.joined()[:30]) & set(whole.joined()[30:])


def test_shingle_sets_tell_texts_apart():
    texts = ["a b c", "a bc", "ab c", "abc", "a b", "b a", "a b c d", "A  B\tC", "é b c", "É b c"]
    for x in texts:
        for y in texts:
            same = np.array_equal(shingle_set(x.encode(), 3), shingle_set(y.encode(), 3))
            assert same == (shingles(x) == shingles(y)), (x, y)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
