"""Cumulative snapshots and rendering."""

import random

from pagewright.llm.chat import prefix_hashes, render

SCHEMA = "conv_id long, turn long, role string, text string, pos string, last string, h1 string"


def brute(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, mine in lists.items():
        if not any(o[: len(mine)] == mine and (len(o) > len(mine) or d < c) for d, o in lists.items() if d != c):
            for p in range(0, len(mine), 256):
                text = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in mine[p : p + 256])
                out[c, p // 256] = (len(mine[p : p + 256]), text)
    return out


def check(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = {(r.conv_id, r.part): (r.n_turns, r.text) for r in render(table).collect()}
    assert got == brute(rows)


def test_snapshots_copies_and_odd_rows(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "done")]
    rows = []
    for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)):
        rows += [(c, i, *x) for i, x in enumerate(a[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other")]
    rows += [(7, 10, "user", "hi"), (7, 30, "assistant", "hello")]  # gaps do not matter
    rows += [(8, None, None, None), (8, 0, "user", ""), (None, 0, "user", "lost"), (9, 0, "user", "b"), (9, 0, "system", "a")]
    rows += [(2, 0, "user", "hi"), (10, -5, "user", "x"), (10, 1 << 62, "user", "y"), (11, 0, "assistant", "hi")]
    check(spark, rows)


def test_long_conversations_over_blocks_and_parts(spark):
    rng = random.Random(4)
    long = [("user" if i % 2 else "assistant", str(rng.random())) for i in range(700)]
    rows = [(1, i, *x) for i, x in enumerate(long)] + [(2, i, *x) for i, x in enumerate(long[:300])]
    rows += [(3, i * 1000, *x) for i, x in enumerate(long[:257])] + [(4, i, *x) for i, x in enumerate(long[:299] + [("user", "end")])]
    check(spark, rows)


def test_first_turn_that_all_share(spark):
    rows = [(c, 0, "system", "same") for c in range(300)] + [(c, 1, "user", str(c % 100)) for c in range(200)]
    check(spark, rows)


def test_empty_table(spark):
    assert render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, 0, "user", "a", "", "", "")], SCHEMA)
    plan = prefix_hashes(table)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
