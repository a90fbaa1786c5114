"""Repair of conversations against trying all edits, and against SQL."""

import hashlib
import itertools
import random

import brute
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import repair as R
from pagewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
ROW = st.tuples(st.sampled_from("suatU "), st.integers(0, 3), st.integers(1, 3))


def all_edits(rows):
    """Least (cost, audit) by listing every sequence of edits."""
    found = []
    choices = []
    for initial, fault, copies in rows:
        one = [(2, "D", "")]
        if fault not in (R.BLANK, R.REPEATED):
            more = 5 * (fault == R.TRUNCATED)
            one += [(more + 1, "R", "u"), (more + 1, "R", "a")]
            one += [(more, "K", initial)] if initial in "sua" else []
        choices += [one] + [[(2, "D", "")]] * (copies - 1)
    gap = [(0, "", ""), (5, "I", "u"), (5, "I", "a"), (10, "II", "ua"), (10, "II", "au")]
    for edits in itertools.product(*itertools.chain(*([gap, c] for c in choices)), gap):
        roles = "".join(e[2] for e in edits)
        body = roles[1:] if roles[:1] == "s" else roles
        if not roles or (body and body == "ua" * (len(body) // 2)):
            found.append((sum(e[0] for e in edits), "".join(e[1] for e in edits)))
    return min(found)


@given(st.lists(ROW, min_size=1, max_size=4).filter(lambda rows: sum(r[2] for r in rows) < 5))
@settings(max_examples=60, deadline=None)
def test_weights_against_all_edits(rows):
    assert R.decide([R.weigh(rows, True)]) == all_edits(rows)


@given(st.lists(ROW, min_size=2, max_size=30), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_blocks_change_nothing(rows, size):
    parts = [R.weigh(rows[i : i + size], i == 0) for i in range(0, len(rows), size)]
    assert R.decide(parts) == R.decide([R.weigh(rows, True)])


def conversations(seed):
    r = random.Random(seed)
    texts = ["Yes.", "No", "ok!", "", " \t", None, "a\u2028.", "\xa0", "why?", "x" * 50_000, "line\nline. "]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(r.randrange(1, 9)):
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 4, 9]), r.choice(["system", "user", "assistant", "tool", None, "", "u"]), r.choice(texts)))
    return rows + rows[:5] + [(7, t, "user", "Same.") for t in range(40)]


@pytest.fixture
def table(spark):
    def make(rows):
        extra = ", c string, at string, text2 string, place long"
        return spark.createDataFrame([(*x, "x", "y", None, 1) for x in rows], "conv_id long, turn long, role string, text string" + extra)

    return make


def by_conversation(rows):
    hurt = {}
    for row in brute.damaged(rows):
        hurt.setdefault(row[0], []).append(row)
    key = lambda row: (row[0] is not None, row[0] or 0)
    return sorted(((c, *brute.repair(hurt.get(c, []))) for c in {r[0] for r in rows}), key=key), key


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, table, tmp_path, seed):
    rows = conversations(seed)
    table(rows).write.parquet(f"{tmp_path}/conversations.parquet")
    want, key = by_conversation(rows)
    got = [tuple(x[c] for c in COLUMNS) for x in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == want


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(ORACLES["op13_conversation_repair"])
    assert want.columns == COLUMNS
    got = [tuple(x[c] for c in COLUMNS) for x in QUERIES["op13_conversation_repair"](spark, SF).collect()]
    assert sorted(got) == sorted(want.fetchall()) and any(r[6] for r in got)


def test_sql_against_brute_force(table, tmp_path):
    rows = conversations(5)
    table(rows).write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    want, key = by_conversation(rows)
    assert sorted(con.sql(ORACLES["op13_conversation_repair"]).fetchall(), key=key) == want


def test_long_conversation_in_blocks(spark, table):
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant"]), f"{t % 700}{r.choice(['.', ''])}") for t in range(3000)]
    rows += [(1, None, "system", "Be kind.")] * 300 + [(2, 5, "user", "Hi.")]
    repair = R.Repair(table(rows), block_rows=64)
    assert repair.blocks.where("size(rows) > 64").count() == 0 and repair.blocks.count() > 40
    (want,) = [brute.repair([x for x in rows if x[0] == 1])]
    (got,) = repair.report().where("conv_id = 1").collect()
    assert tuple(got[c] for c in COLUMNS[1:-1]) == want[:-1]
    lines = [f"{t.role}:{t.text}" for t in repair.turns().where("c = '=1'").orderBy("place").collect()]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[-1]


def test_empty_table(spark, table):
    repair = R.Repair(table([]))
    assert repair.report().collect() == [] and repair.turns().collect() == [] and repair.digests().collect() == []
