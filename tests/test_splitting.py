"""The splitter against hand-worked cases and a direct statement of its rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions.splitting import split_text
from pagewright.operators.chunking import chunk_documents

SEPARATORS = ["\n\n", "\n", " ", ""]


@pytest.mark.parametrize(
    "text, size, overlap, expected",
    [
        ("aa bb cc dd ee", 8, 3, ["aa bb cc", "cc dd ee"]),
        ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
        ("one two\n\nthree four five\n\nsix", 12, 0, ["one two", "three four", "five", "six"]),
        ("para one.\n\npara two is longer than that", 12, 4, ["para one.", "para two is", "is longer", "than that"]),
        ("abcd efgh", 4, 0, ["abcd", "efgh"]),
    ],
)
def test_golden(text, size, overlap, expected):
    assert [c for c, _, _ in split_text(text, size, overlap)] == expected


def pack(parts, sep, size, overlap):
    out, current, total = [], [], 0
    for part in parts:
        if total + len(part) + len(current) * len(sep) > size and current:
            if sep.join(current).strip():
                out.append(sep.join(current).strip())
            while total > overlap or (total + len(part) + len(current) * len(sep) > size and total > 0):
                total -= len(current.pop(0))
        current.append(part)
        total += len(part)
    if sep.join(current).strip():
        out.append(sep.join(current).strip())
    return out


def brute(text, size, overlap, separators):
    sep, later = separators[-1], None
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, later = s, (separators[i + 1 :] if s else None)
            break
    parts = [p for p in (text if sep == "" else text.split(sep)) if p]
    out, run = [], []
    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        if run:
            out += pack(run, sep, size, overlap)
            run = []
        out += brute(p, size, overlap, later) if later else [p]
    return out + (pack(run, sep, size, overlap) if run else [])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abé \n", max_size=80), st.integers(2, 20), st.data())
def test_equals_direct_rules(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    chunks = list(split_text(text, size, overlap))
    assert [c for c, _, _ in chunks] == brute(text, size, overlap, SEPARATORS)
    assert all(text[s:e].split() == c.split() for c, s, e in chunks)
    if overlap == 0:
        assert "".join("".join(c.split()) for c, _, _ in chunks) == "".join(text.split())


def test_edge_documents(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, " \n "), (3, "x" * 950), (4, "y" * 1000), (5, "a\r\nb"), (6, "one two"), (7, "word " * 600)],
        "doc_id long, text string",
    )
    rows = chunk_documents(docs, "text", 1000, 100).orderBy("doc_id", "chunk_index").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {3, 4, 5, 6, 7}
    assert [r.length for r in by_doc[4]] == [1000]
    assert by_doc[5][0].content == "a\nb"
    assert by_doc[6][0].content == "one two"
    many = by_doc[7]
    assert [r.chunk_index for r in many] == list(range(len(many))) and many[0].total_chunks == len(many)
    assert many[0].is_first and many[-1].is_last and many[0].overlap_start == 0 and many[-1].overlap_end == 0
    empty = chunk_documents(docs, "text", 1000, 100, keep_empty=True).where("content IS NULL")
    assert sorted(r.doc_id for r in empty.collect()) == [1, 2]
