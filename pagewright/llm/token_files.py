"""Token ids in binary files with a shared zstandard dictionary.

A data set is a folder with three parts.

``shards/``      files of one range of ``doc_id`` each, in ascending order. A file holds records, each
                 followed by one newline byte: a header (``PWTF``, version, id width, shard number,
                 SHA-256 of the dictionary), one zstandard frame per document, an index (doc ids,
                 null marks, frame offsets, frame lengths, token counts) and a footer that says
                 where the index is. A document can be read alone through the index.
``dictionary/``  the dictionary and its SHA-256.
``manifest/``    per shard: first and last doc id, documents, tokens, tokens before it.

Spark's text writer puts the records down and commits the files, Spark's ``binaryFile`` reader brings
them back, so any store Spark knows works, and a lost executor costs a repeated task only.

Null text counts as empty and gives one token, the end id. Null ids sort first; equal ids keep all their
rows, ordered by a hash of the text. An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.arrow import byte_texts, text_portions
from pagewright.llm.ids import GROUP_BYTES, default_path, encoder, release
from pagewright.llm.sampling import drawn

MAGIC, END = b"PWTF", b"FTWP"
_HEADER, _FOOTER = "<4sBBI32s", "<QQQQ4s"
#: The dictionary is trained on so many documents at most, each of so many characters at most:
#: it serves short documents, long ones compress well alone.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 8000, 64 * 1024
LEVEL = 3


def train_dictionary(documents: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the ids of a bounded sample, drawn by a hash of the row; empty if too little."""
    short = documents.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    sample = drawn(short, SAMPLE_DOCUMENTS, "dictionary", of=documents.count()).select("text")

    def ids(batches):
        release(keep=tokenizer)
        enc = encoder(tokenizer)
        for b in text_portions(batches, 0, GROUP_BYTES):
            yield pa.record_batch([pa.array([_serial(x, enc, end_id) for x in enc.encode(byte_texts(b.column(0)))], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in sample.mapInArrow(ids, "ids binary").collect()]
    if len(samples) < 16 or sum(map(len, samples)) < 16 * 1024:
        return b""
    return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, level=LEVEL).as_bytes()


def _serial(ids: bytes, enc, end_id: int) -> bytes:
    return ids + np.array([end_id], enc.dtype).tobytes()


def write_token_files(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode ``documents`` (doc_id, text) into a new data set at ``path``."""
    spark = documents.sparkSession
    tokenizer = tokenizer or default_path()
    dictionary = train_dictionary(documents, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    order = ["doc_id", "_tie"]
    ranged = (
        documents.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
        .sortWithinPartitions(*order)
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    )

    def shard(batches):
        release(keep=tokenizer)
        enc, out, at = encoder(tokenizer), [], 0
        press = _compressor(dictionary)
        docs, gone, places, sizes, counts = [], [], [], [], []
        width = enc.dtype.itemsize
        for b in text_portions(batches, 1, GROUP_BYTES):
            out = []
            if not docs:
                out.append(struct.pack(_HEADER, MAGIC, 1, width, TaskContext.get().partitionId(), digest))
                at = len(out[0]) + 1
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(byte_texts(b.column(1)))):
                raw = _serial(ids, enc, end_id)
                out.append(press.compress(raw))
                docs.append(doc or 0)
                gone.append(doc is None)
                places.append(at)
                sizes.append(len(out[-1]))
                counts.append(len(raw) // width)
                at += sizes[-1] + 1
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
        if docs:
            index = b"".join(
                np.array(x, t).tobytes() for x, t in ((docs, "<i8"), (gone, "u1"), (places, "<u8"), (sizes, "<u8"), (counts, "<u8"))
            )
            footer = struct.pack(_FOOTER, at, len(index), len(docs), sum(counts), END)
            yield pa.record_batch([pa.array([index, footer], pa.binary())], ["record"])

    # The text writer puts bytes down as they are; a record is bytes, not text.
    ranged.mapInArrow(shard, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "compression", "none"
    ).text(f"{path}/shards")
    _write_manifest(spark, path)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards").select("path", "content")


def _index(content: bytes):
    """Header fields and index columns of one file."""
    magic, version, width, shard, digest = struct.unpack_from(_HEADER, content)
    at, size, n, tokens, end = struct.unpack_from(_FOOTER, content, len(content) - struct.calcsize(_FOOTER) - 1)
    if magic != MAGIC or end != END or version != 1:
        raise ValueError("not a token file")
    docs = np.frombuffer(content, "<i8", n, at)
    gone = np.frombuffer(content, "u1", n, at + 8 * n).astype(bool)
    places, sizes, counts = (np.frombuffer(content, "<u8", n, at + 9 * n + 8 * n * k) for k in range(3))
    return width, shard, digest, tokens, docs, gone, places.astype(np.int64), sizes.astype(np.int64), counts.astype(np.int64)


def _write_manifest(spark: SparkSession, path: str) -> None:
    def facts(batches):
        for b in batches:
            rows = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                _, shard, _, tokens, docs, gone, *_ = _index(content.as_buffer())
                real = docs[~gone]
                rows.append((shard, name, int(real[0]) if len(real) else None, int(real[-1]) if len(real) else None, len(docs), tokens))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), *[pa.int64()] * 4))],
                ["shard", "file", "first_doc", "last_doc", "n_docs", "n_tokens"],
            )

    # One row per file, so this window without a key holds no more rows than there are files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    _files(spark, path).mapInArrow(
        facts, "shard int, file string, first_doc long, last_doc long, n_docs long, n_tokens long"
    ).withColumn("tokens_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/manifest")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes.fromhex(row.sha256), bytes(row.bytes)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a data set: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``doc_ids`` names a few documents: then only the files that can hold them are opened, and only
    their frames are decompressed.
    """
    digest, dictionary = _dictionary(spark, path)
    manifest = spark.read.parquet(f"{path}/manifest")
    files = _files(spark, path)
    if doc_ids is not None:
        may = F.lit(False)
        for d in doc_ids:
            may |= F.lit(d).between(F.col("first_doc"), F.col("last_doc"))
        names = [r.file for r in manifest.where(may).select("file").collect()]
        files = files.where(F.col("path").isin(names))
    wanted = None if doc_ids is None else np.array(doc_ids, np.int64)

    def documents(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdDecompressor(dict_data=data)
        for b in batches:
            for content in b.column(1):
                content = memoryview(content.as_buffer())
                width, shard, made, _, docs, gone, places, sizes, counts = _index(content)
                if made != digest:
                    raise ValueError("the file was written with another dictionary")
                starts = np.cumsum(counts) - counts
                take = np.arange(len(docs)) if wanted is None else np.flatnonzero(np.isin(docs, wanted) & ~gone)
                for i in range(0, len(take), 1000):
                    some = take[i : i + 1000]
                    ids = [
                        np.frombuffer(press.decompress(content[p : p + s]), f"<u{width}").astype("<u4")
                        for p, s in zip(places[some].tolist(), sizes[some].tolist())
                    ]
                    columns = [
                        pa.array(docs[some], mask=gone[some]),
                        pa.array(np.full(len(some), shard, np.int32)),
                        pa.array(starts[some]),
                        pa.array(counts[some]),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "_local", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, shard int, _local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return (
        files.mapInArrow(documents, schema)
        .join(manifest.select("shard", "tokens_before"), "shard")
        .select(
            "doc_id",
            (F.col("tokens_before") + F.col("_local")).alias("start"),
            "n_tokens",
            "ids_crc32",
            *(["ids"] if with_ids else []),
        )
    )
