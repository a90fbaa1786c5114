"""Benchmark decontamination with one FM-index per shard of training documents.

Benchmark items become windows of 13 consecutive words (an item of fewer words is one window). A task
gathers documents into shards, writes each as numbers (a word of the benchmark, or one mark for any
run of other words and for a document's end), indexes them, searches all windows backward through
wavelet-tree ranks, locates the occurrences through sampled suffix positions and merges them into
spans of words to remove.

The benchmark reaches the tasks in blocks of bounded size, each a broadcast of its own, so neither the
driver nor a task holds more than one block; every shard meets every block. Documents are not shuffled.

Nulls: a text or item without words has none and matches nothing. A window of an item whose id is null
marks words, but the item is neither counted nor listed. Repeated item ids count once. Null and
repeated doc ids keep their rows. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.llm.arrow import byte_texts, text_portions
from pagewright.llm.fm_index import FMIndex
from pagewright.llm.ids import release
from pagewright.session import cut_lineage

WINDOW = 13
#: Words a shard holds before it is indexed; a longer document is cut into overlapping segments.
SHARD_WORDS = 400_000
#: Bytes of texts that are cut into words at a time.
PORTION_BYTES = 4 << 20
#: Characters of benchmark text in one block.
BLOCK_CHARS = 16_000_000

#: A to Z to lower case, ASCII that is no word character to a blank, all else as it is.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Windows:
    """The windows of one block: a matrix of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found[tuple(ids[i : i + size])].add(item)
        self.symbols = len(self.number) + 2  # 0: end, 1: other words
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.matrix = np.zeros((len(found), size), np.int64)
        for row, w in enumerate(found):
            self.matrix[row, size - len(w) :] = w
        self.items = [sorted(x for x in i if x is not None) for i in found.values()]

    def search(self, segments: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(segment, first word, words, window) of every occurrence in lists of word numbers."""
        if not len(self.lengths):
            return []
        # One mark for each run of other words; `at` keeps the place of every symbol.
        lengths = np.array([len(s) + 1 for s in segments])
        text = np.ones(lengths.sum(), np.int64)
        ends = np.cumsum(lengths)
        for s, end in zip(segments, ends):
            text[end - 1 - len(s) : end - 1] = s
        keep = np.ones(len(text), bool)
        keep[1:] = (text[1:] != 1) | (text[:-1] != 1)
        at = np.flatnonzero(keep)
        index = FMIndex(text[at], self.symbols)
        low, high = index.ranges(self.matrix, self.lengths)
        many = high - low
        many[many < 0] = 0
        window = np.repeat(np.arange(len(many)), many)
        if not len(window):
            return []
        rows = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + low[window]
        place = at[index.locate(rows)]
        segment = np.searchsorted(ends, place, side="right")
        first = place - (ends - lengths)[segment]
        return list(zip(segment.tolist(), first.tolist(), self.lengths[window].tolist(), window.tolist()))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, merged where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, size: int, block_chars: int) -> list[Broadcast]:
    """Windows of all different items, in blocks of at most ``block_chars`` characters, or one bucket of items more.

    Items that are repeated count once. A hash deals them into buckets of about an eighth of a block; the
    characters of the buckets, summed up in order, say where a block ends.
    """
    spark = benchmark.sparkSession
    items = cut_lineage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars * 8 // block_chars)) if chars > block_chars else 1
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    sums = items.groupBy(bucket.alias("bucket")).agg(F.sum(F.length("text")).alias("chars")).orderBy("bucket").collect()
    ranges: list[list[int]] = []
    held = block_chars
    for row in sums:
        if held >= block_chars:
            ranges.append([row.bucket, row.bucket])
            held = 0
        ranges[-1][1] = row.bucket
        held += row.chars
    out = []
    for first, last in ranges or [[0, 0]]:
        rows = items.where(bucket.between(first, last)).collect()
        out.append(spark.sparkContext.broadcast(Windows([(r.item_id, r.text.encode()) for r in rows], size)))
    return out


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): n_words, n_hit, item_ids and the merged word spans.

    ``spans`` are half-open ranges of word numbers from 0, ascending and apart; ``n_hit`` is the sum
    of their lengths; ``item_ids`` are the items with occurring windows, sorted as strings.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _searched(narrow, ["doc_id"], benchmark, window, shard_words, block_chars)


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all columns as they were."""
    names = [f"_{i}" for i in range(len(documents.columns))]
    searched = _searched(documents.toDF(*names), names, benchmark, window, shard_words, block_chars, names[documents.columns.index("text")])
    return searched.where(~is_contaminated()).select(names).toDF(*documents.columns)


def is_contaminated() -> Column:
    """At least a twentieth of the words, and at least one, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _searched(documents, carried, benchmark, window, shard_words, block_chars, text="text") -> DataFrame:
    """Columns ``carried`` of the documents with what was found in their texts."""
    blocks = _blocks(benchmark, window, block_chars)
    n = len(carried)

    def search(batches):
        release()
        rows, lists, filled = [], [], 0
        for b in text_portions(batches, n, PORTION_BYTES):
            done = 0
            for k, t in enumerate(byte_texts(b.column(n))):
                lists.append(words_of(t))
                filled += len(lists[-1])
                if filled >= shard_words:
                    rows.append(b.slice(done, k + 1 - done))
                    yield _shard(rows, carried, lists, blocks, window, shard_words)
                    rows, lists, filled, done = [], [], 0, k + 1
            rows.append(b.slice(done))
        if lists:
            yield _shard(rows, carried, lists, blocks, window, shard_words)

    found = StructType.fromDDL("n_words long, n_hit long, item_ids array<string>, spans array<struct<first:long,end:long>>")
    shape = StructType(documents.select(carried).schema.fields + found.fields)
    return documents.select(*carried, F.col(text).alias("_text")).mapInArrow(search, shape)


def _shard(rows, carried, lists, blocks, window, shard_words) -> pa.RecordBatch:
    """Search the gathered documents; their rows with what was found."""
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for block in blocks:
        known = block.value
        get = known.number.get
        segments, owner, start = [], [], []
        for doc, words in enumerate(lists):
            numbers = np.fromiter(map(get, words, repeat(1)), np.int32, len(words))
            for at in range(0, max(1, len(numbers) - window + 1), shard_words):
                segments.append(numbers[at : at + shard_words + window - 1])
                owner.append(doc)
                start.append(at)
        seen: dict[int, set] = defaultdict(set)
        for k, first, length, w in known.search(segments):
            doc, first = owner[k], first + start[k]
            spans[doc].append((first, first + length))
            seen[doc].add(w)
        for doc, found in seen.items():
            for w in found:
                items[doc].update(known.items[w])
        if len(blocks) > 1:
            del block._value  # else a worker would keep every block it has met
    merged = {doc: merge_spans(s) for doc, s in spans.items()}
    n = range(len(lists))
    batch = pa.Table.from_batches(rows).combine_chunks().select(range(len(carried)))
    found = [
        pa.array([len(w) for w in lists], pa.int64()),
        pa.array([sum(b - a for a, b in merged.get(d, ())) for d in n], pa.int64()),
        pa.array([sorted(map(str, items.get(d, ()))) for d in n], pa.list_(pa.string())),
        pa.array(
            [[{"first": a, "end": b} for a, b in merged.get(d, ())] for d in n],
            pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])),
        ),
    ]
    columns = [c.chunk(0) for c in batch.columns]
    return pa.RecordBatch.from_arrays(columns + found, [*batch.column_names, "n_words", "n_hit", "item_ids", "spans"])
