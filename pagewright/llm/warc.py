"""WARC records, and revisits resolved to the response they stand for.

A server answers a conditional request with "not modified" (304), and the archive keeps a revisit record
without a body. ``resolve_revisits`` finds, for each revisit, the latest earlier full response of the same
canonical URL, checks that the validators agree and gives the response's body with its headers, updated by
those that a 304 may update.

The as-of join moves narrow rows only. A URL's captures are looked at in blocks of ``BLOCK_SECONDS``: inside a
block a window finds the latest response before each revisit, and the last response of each block
is carried over the later ones, one row per block. So a URL that holds much of the archive is
spread over many groups. Bodies come last, by a plain join on the response's id.

Results of a revisit: ``resolved``; ``validator_mismatch`` if an ETag (compared weakly) or Last-Modified that both
have differs, or they share neither; ``no_response`` if there is no earlier full response, or the
revisit lacks URL or time. "Earlier" is strict; of responses at one time the greatest record id counts.
Full responses are those with status 200 and a URL, time and id. Rows that repeat a record id, URL and
time count once. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.arrow import portions

BLOCK_SECONDS = 6 * 3600
# Header fields that a 304 response may update (RFC 9110, 15.4.5), and Last-Modified.
MAY_UPDATE = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

CAPTURE = (
    "record_id string, kind string, url string, captured_at timestamp, status int, headers map<string,string>, body binary"
)


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, fragment, tracking parameters and last slash; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", "")
    rest = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*(.*)$", 1), "([?&])(?:utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, "/+$", ""))


def warc_record(
    record_id: Column, kind: Column, url: Column, captured_at: Column, status_line: Column, headers: Column, body: Column
) -> Column:
    """The bytes of one WARC record around an HTTP response; ``headers`` is a map, ``body`` a string."""
    lines = F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e.key, F.lit(": "), e.value, F.lit("\r\n"))), "")
    content = F.concat(status_line, F.lit("\r\n"), lines, F.lit("\r\n"), body)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <"), record_id,
        F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: "), F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"), content, F.lit("\r\n\r\n"),
    ).cast("binary")


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    """First line and named fields (names in lower case; repeated ones joined by a comma)."""
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
    return first, found


def records_of(blob: bytes) -> Iterator[tuple]:
    """Response and revisit records of a WARC file, plain or of gzip members, as rows of ``CAPTURE``.

    A record cut off at the end of the file is not given; other record types are passed over.
    """
    if blob[:2] == b"\x1f\x8b":
        blob = gzip.decompress(blob)
    at = 0
    while (start := blob.find(b"WARC/", at)) >= 0 and (end := blob.find(b"\r\n\r\n", start)) >= 0:
        _, named = _fields(blob[start:end])
        size = named.get("content-length", "")
        at = end + 4 + (int(size) if size.isdigit() else 0)
        if at > len(blob):
            return
        kind = named.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        head, _, body = blob[end + 4 : at].partition(b"\r\n\r\n")
        line, headers = _fields(head)
        status = line.split(" ")[1:2]
        yield (
            named.get("warc-record-id", "").strip("<>") or None, kind, named.get("warc-target-uri"), named.get("warc-date"),
            int(status[0]) if status and status[0].isdigit() else None, list(headers.items()), body,
        )


def read_records(blobs: DataFrame, column: str = "content") -> DataFrame:
    """Captures in a column of WARC bytes (files read as ``binaryFile``, or single records)."""

    def parse(batches):
        for b in portions(batches, 200):
            rows = [r for blob in b.column(0).to_pylist() if blob for r in records_of(blob)]
            kinds = [pa.string()] * 4 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["record_id", "kind", "url", "captured_at", "status", "headers", "body"]
            )

    parsed = blobs.select(F.col(column)).mapInArrow(parse, CAPTURE.replace("timestamp", "string"))
    return parsed.withColumn("captured_at", F.try_to_timestamp("captured_at"))


def resolve_revisits(captures: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Per revisit of ``captures`` (see ``CAPTURE``): record_id, url (canonical), captured_at, result, response_id,
    headers (merged) and body; the last three are null unless resolved."""
    known = captures.withColumn("url", canonical_url(F.col("url")))
    full = known.where("kind = 'response' AND status = 200 AND url IS NOT NULL AND captured_at IS NOT NULL AND record_id IS NOT NULL")
    full = full.select(
        F.col("record_id").alias("response_id"), "url", F.col("captured_at").alias("at"), F.col("headers").alias("old"), "body"
    ).dropDuplicates(["response_id", "url", "at"])
    revisits = known.where("kind = 'revisit'").select("record_id", "url", "captured_at", "headers").dropDuplicates(["record_id", "url", "captured_at"])

    block = F.floor(F.unix_timestamp("at") / block_seconds).alias("block")
    points = full.select("url", "at", block, F.struct("at", "response_id").alias("response"), F.lit(None).cast("string").alias("record_id"))
    asked = revisits.where("url IS NOT NULL AND captured_at IS NOT NULL").select("url", F.col("captured_at").alias("at"), "record_id")
    points = points.unionByName(asked.withColumns({"block": block, "response": F.lit(None).cast(points.schema["response"].dataType)}))
    # Revisits sort before responses of the same time, so they see strictly earlier ones.
    inside = Window.partitionBy("url", "block").orderBy("at", F.col("response").isNotNull(), "response").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy("url", "block").agg(F.max("response").alias("_last")).select(
        "url", "block", F.last("_last", ignorenulls=True).over(before).alias("carried")
    )
    found = (
        points.withColumn("near", F.last("response", ignorenulls=True).over(inside))
        .where("response IS NULL")
        .join(carried, ["url", "block"])
        .select("url", F.col("at").alias("captured_at"), "record_id", F.coalesce("near", "carried").alias("_r"))
        .select("url", "captured_at", "record_id", F.col("_r.response_id").alias("response_id"), F.col("_r.at").alias("at"))
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = found.select(*(F.col(c).alias(f"_{c}") for c in found.columns))
    joined = revisits.join(named, same("record_id", "_record_id") & same("url", "_url") & same("captured_at", "_captured_at"), "left")
    joined = joined.select("record_id", "url", "captured_at", "headers", F.col("_response_id").alias("response_id"), F.col("_at").alias("at"))
    joined = joined.join(full, ["response_id", "url", "at"], "left")

    def differ(name: str, value) -> Column:
        new, old = F.col("headers")[name], F.col("old")[name]
        return F.when(new.isNotNull() & old.isNotNull(), value(new) != value(old))

    tag, modified = differ("etag", lambda x: F.regexp_replace(x, "^W/", "")), differ("last-modified", lambda x: x)
    agree = (tag.isNotNull() | modified.isNotNull()) & ~F.coalesce(tag, F.lit(False)) & ~F.coalesce(modified, F.lit(False))
    result = F.when(F.col("response_id").isNull(), "no_response").when(agree, "resolved").otherwise("validator_mismatch")
    updates = F.map_filter("headers", lambda k, _: k.isin(MAY_UPDATE))
    kept = F.map_filter("old", lambda k, _: ~F.map_contains_key(updates, k))
    ok = F.col("result") == "resolved"
    return joined.withColumn("result", result).select(
        "record_id",
        "url",
        "captured_at",
        "result",
        F.when(ok, F.col("response_id")).alias("response_id"),
        F.when(ok, F.map_concat(kept, updates)).alias("headers"),
        F.when(ok, F.col("body")).alias("body"),
    )
