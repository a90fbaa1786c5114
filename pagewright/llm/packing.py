"""Packing token pieces into sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so an instance of any size is a histogram of at most
``capacity`` counts. The plan is made on that histogram alone, in runs: "so many pieces of this
length, so many to a bin, from this bin on, at this place". Runs number a few times the capacity,
whatever the size of the corpus. Spark counts the histogram, numbers the pieces of each length
and looks each number up in the runs.

Reduction (Martello and Toth): for a longest remaining length j, a set of at most three pieces with j
is fixed for good if it dominates every other set that holds j, which means every such set can be
taken apart so that its parts fit under pieces of the fixed set. Removing pieces never breaks the
conditions used here, so each fix is applied to as many copies as there are, and passes over the
lengths repeat until none fixes anything. What is left goes by best fit, longest first.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.arrow import byte_texts, text_portions
from pagewright.llm.ids import GROUP_BYTES, default_path, encoder, release
from pagewright.session import cut_lineage

CAPACITY = 4096
#: Pieces numbered in one window group; a length with more of them is numbered in several.
GROUP_ROWS = 200


class _Stock:
    """Counts by length, with the lengths that remain in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.count)
        self.used: dict[int, int] = defaultdict(int)

    def at_most(self, limit: int, count_of: dict[int, int] | None = None) -> int | None:
        i = bisect.bisect_right(self.lengths, limit)
        return self.lengths[i - 1] if i else None

    def above(self, limit: int) -> int | None:
        i = bisect.bisect_right(self.lengths, limit)
        return self.lengths[i] if i < len(self.lengths) else None

    def smallest(self, how_many: int, without: int) -> list[int]:
        """The smallest lengths, by copies, one copy of ``without`` set aside."""
        out: list[int] = []
        for n in self.lengths:
            out += [n] * min(how_many - len(out), self.count[n] - (n == without))
            if len(out) >= how_many:
                break
        return out

    def take(self, length: int, n: int) -> int:
        """Remove n copies; the rank of the first of them."""
        first = self.used[length]
        self.used[length] += n
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))
        return first


def _largest(stock: _Stock, limit: int, taken: list[int]) -> int | None:
    """The largest length of at most ``limit`` of which a copy is left beside ``taken``."""
    i = bisect.bisect_right(stock.lengths, limit) - 1
    while i >= 0 and stock.count[stock.lengths[i]] <= taken.count(stock.lengths[i]):
        i -= 1
    return stock.lengths[i] if i >= 0 else None


def dominant_set(stock: _Stock, j: int, capacity: int) -> list[int] | None:
    """Lengths (j among them) that dominate every feasible set with j, or None if not shown."""
    room = capacity - j
    mate = _largest(stock, room, [j])
    if mate is None:
        return [j]
    if mate == room:  # whatever else fits sums to no more than this one piece
        return [j, mate]
    small = stock.smallest(3, without=j)
    if len(small) < 2 or small[0] + small[1] > room:  # one more piece at most
        return [j, mate]
    if len(small) > 2 and sum(small) <= room:
        return None
    # Two more at most. {mate, second} covers every pair whose smaller piece is at most `second`,
    # and the single mate covers every pair of at most its own length.
    second = _largest(stock, room - mate, [j, mate])
    if second is None:
        # No pair contains the mate; the mate alone dominates if the best pair is no longer than it.
        return [j, mate] if room <= mate else None
    larger = [n for n in _next_copies(stock, second, [j]) if n <= room]
    if len(larger) < 2 or sum(larger) > room:
        return [j, mate, second]
    return None


def _next_copies(stock: _Stock, above: int, taken: list[int]) -> list[int]:
    """The two smallest copies longer than ``above``, beside ``taken``."""
    out: list[int] = []
    i = bisect.bisect_right(stock.lengths, above)
    while i < len(stock.lengths) and len(out) < 2:
        n = stock.lengths[i]
        out += [n] * min(2 - len(out), stock.count[n] - taken.count(n))
        i += 1
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, pieces per bin, first bin, place) and the number of bins."""
    stock = _Stock(counts)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    fixed = True
    while fixed:
        fixed = False
        for j in list(reversed(stock.lengths)):
            while j in stock.count and (chosen := dominant_set(stock, j, capacity)):
                times = min(stock.count[n] // chosen.count(n) for n in set(chosen))
                place = 0
                for n in sorted(set(chosen), reverse=True):
                    each = chosen.count(n)
                    runs.append((n, stock.take(n, times * each), times * each, each, bins, place))
                    place += n * each
                bins += times
                fixed = True
    # Best fit, longest first. Open bins of one fill are ranges of bin numbers.
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put_back(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins[room].append((first, n))

    for length in list(reversed(stock.lengths)):
        left = stock.count[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length  # a bin stays the tightest one until no more fit
            full = min(n, left // each)
            if full:
                runs.append((length, stock.take(length, full * each), full * each, each, first, capacity - room))
                put_back(room - each * length, first, full)
                left -= full * each
            if left and full < n:
                runs.append((length, stock.take(length, left), left, left, first + full, capacity - room))
                put_back(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put_back(room, first + full, n - full)
    return runs, bins




def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; its lengths lie between 1 and ``capacity``.

    All columns of ``pieces`` are kept (it must not have ones of these two names). An empty table stays
    empty. Rows that are equal in all columns may swap places.
    """
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces)
    # At most `capacity` rows reach the driver.
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    runs, _ = plan(counts, capacity)
    by_length = defaultdict(list)
    for n, *run in runs:
        by_length[n].append(tuple(run))
    # At most `capacity` rows, a few runs each: small enough to broadcast whatever the corpus.
    look_up = F.broadcast(
        spark.createDataFrame(
            [(n, -(-c // GROUP_ROWS), by_length[n]) for n, c in counts.items()],
            "_n int, _groups int, _runs array<struct<first:long,n:long,each:long,bin:long,place:long>>",
        )
    )
    names = pieces.columns
    hashed = F.xxhash64(*names)
    grouped = pieces.join(look_up.select("_n", "_groups"), F.col(length) == F.col("_n")).withColumn(
        "_group", F.pmod(hashed, F.col("_groups"))
    )
    sizes = grouped.groupBy("_n", "_group").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_n").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_n", "_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_n", "_group").orderBy(*names)
    numbered = (
        grouped.withColumn("_in", F.row_number().over(inside) - 1)
        .join(bases, ["_n", "_group"])
        .withColumn("_rank", F.col("_base") + F.col("_in"))
        .select(*names, "_n", "_rank")
    )
    run = F.filter("_runs", lambda r: (r.first <= F.col("_rank")) & (F.col("_rank") < r.first + r.n))[0]
    nth = F.col("_rank") - F.col("_run.first")
    return (
        numbered.join(look_up.select("_n", "_runs"), "_n")
        .withColumn("_run", run)
        .select(
            *names,
            (F.col("_run.bin") + F.floor(nth / F.col("_run.each"))).cast("long").alias("sequence_id"),
            (F.col("_run.place") + nth % F.col("_run.each") * F.col(length)).cast("long").alias("offset"),
        )
    )


def pieces_of(
    documents: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``capacity`` ids.

    Columns: doc_id, piece, start, length, ids_crc32 and, if asked for, ids. Null text is empty
    and so one piece that holds the end id; null or repeated doc ids keep their rows.
    """
    tokenizer = tokenizer or default_path()

    def cut(batches):
        release(keep=tokenizer)
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in text_portions(batches, 1, GROUP_BYTES):
            docs, pieces, starts, lengths, crcs, parts = [], [], [], [], [], []
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(byte_texts(b.column(1)))):
                ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    docs.append(doc)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part.astype(np.int64))
            columns = [
                pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack_documents(documents: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as packed pieces, see :func:`pieces_of` and :func:`pack`."""
    return pack(pieces_of(documents, tokenizer, end_id, capacity, with_ids), capacity)
