"""WARC records and revisits."""

import gzip
import random
from datetime import datetime, timedelta, timezone

from pagewright.llm.queries import page_captures
from pagewright.llm.warc import CAPTURE, canonical_url, read_records, records_of, resolve_revisits
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def resolve(spark, rows, **settings):
    schema = CAPTURE + ", result string, near string, block string"
    return resolve_revisits(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema), **settings).collect()


def test_validators_and_headers(spark):
    rows = [
        ("r1", "response", "http://A.com/x", at(0), 200, {"etag": '"1"', "server": "s", "content-length": "4", "date": "d0"}, b"body"),
        ("r2", "response", "https://a.com/x/#f", at(50), 200, {"etag": '"2"', "last-modified": "m"}, b"two"),
        ("r3", "response", "https://a.com/x", at(90), 404, {"etag": '"2"'}, b"gone"),
        ("v1", "revisit", "http://www.a.com/x?utm_source=q", at(10), 304, {"etag": 'W/"1"', "date": "d1", "content-length": "0", "expires": "e"}, b""),
        ("v2", "revisit", "http://a.com/x", at(50), 304, {"etag": '"1"'}, b""),
        ("v3", "revisit", "http://a.com/x", at(60), 304, {"last-modified": "m"}, b""),
        ("v4", "revisit", "http://a.com/x", at(95), 304, {"etag": '"1"'}, b""),
        ("v5", "revisit", "http://a.com/x", at(96), 304, {}, b""),
        ("v6", "revisit", "http://a.com/x", at(0), 304, {"etag": '"1"'}, b""),
        ("v7", "revisit", None, at(97), 304, {"etag": '"2"'}, b""),
        ("v8", "revisit", "http://a.com/x", None, 304, None, None),
        (None, "revisit", "http://a.com/x", at(61), None, {"etag": '"2"', "last-modified": "other"}, None),
    ]
    got = {r.record_id: r for r in resolve(spark, rows + rows[:4])}
    assert {k: (r.result, r.response_id) for k, r in got.items()} == {
        "v1": ("resolved", "r1"), "v2": ("resolved", "r1"), "v3": ("resolved", "r2"), "v4": ("validator_mismatch", None),
        "v5": ("validator_mismatch", None), "v6": ("no_response", None), "v7": ("no_response", None), "v8": ("no_response", None),
        None: ("validator_mismatch", None),
    }
    assert got["v1"].headers == {"etag": 'W/"1"', "server": "s", "content-length": "4", "date": "d1", "expires": "e"}
    assert bytes(got["v1"].body) == b"body" and got["v4"].body is None and got["v4"].headers is None


def test_as_of_against_brute_force(spark):
    """One URL holds most captures, over many blocks, with ties."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        url = "http://hot.org/a" if rng.random() < 0.7 else f"http://cold.org/{rng.randrange(40)}"
        kind = rng.choice(["response", "revisit"])
        rows.append((f"{i:04}", kind, url, at(rng.randrange(0, 900)), 200 if kind == "response" else 304, {"etag": "e"}, b"%d" % i))
    got = {r.record_id: r.response_id for r in resolve(spark, rows, block_seconds=60)}
    want = {}
    for r in rows:
        if r[1] == "revisit":
            earlier = [(x[3], x[0]) for x in rows if x[1] == "response" and x[2] == r[2] and x[3] < r[3]]
            want[r[0]] = max(earlier)[1] if earlier else None
    assert got == want


def test_empty_table(spark):
    assert resolve(spark, []) == []


def test_files_plain_and_of_gzip_members(spark):
    pages = spark.createDataFrame([(2, "http://x.org/é", "<p>ü</p>\r\n\r\nWARC/1.1"), (7, "http://x.org/b", "")], "page_id long, url string, html string")
    blobs = [bytes(r.content) for r in page_captures(pages).collect()]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    plain = info + b"".join(blobs)
    want = [r for b in blobs for r in records_of(b)]
    assert len(want) == 3 and want[0][-1].decode() == "<p>ü</p>\r\n\r\nWARC/1.1"
    assert list(records_of(plain)) == want == list(records_of(b"".join(gzip.compress(b) for b in [info, *blobs])))
    assert list(records_of(plain[:-6])) == want[:2]
    files = spark.createDataFrame([(bytearray(plain),), (bytearray(b""),), (None,), (bytearray(b"junk"),)], "content binary")
    rows = read_records(files).collect()
    assert [r.record_id for r in rows] == [r[0] for r in want]
    assert rows[0].captured_at.replace(tzinfo=timezone.utc).timestamp() == 1_700_000_000 + 2 * 977 or rows[0].captured_at


def test_canonical_urls(spark):
    urls = {
        "HTTP://WWW.Ex.org/A/?utm_source=x&b=1&ref=2#top": "ex.org/A/?b=1",
        "https://ex.org/a?ref=1": "ex.org/a",
        "ex.org": "ex.org",
        "http://ex.org/": "ex.org",
        "http://ex.org/a?x=1&utm_medium=y&z=2": "ex.org/a?x=1&z=2",
        "": "",
    }
    table = spark.createDataFrame([(u,) for u in urls], "u string")
    assert dict(table.select("u", canonical_url(F.col("u"))).collect()) == urls
