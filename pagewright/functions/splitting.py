"""The recursive separator split as an Arrow function inside Spark tasks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import WS_CHARS
from .lengths import length_function

CHUNK_TYPE = "array<struct<content:string,start_offset:int,end_offset:int>>"
COUNTED_CHUNK_TYPE = "array<struct<content:string,start_offset:int,end_offset:int,tokens:int>>"

Piece = tuple[int, int]  # start and end in the document


def _pieces(text: str, start: int, end: int, sep: str, keep: bool) -> list[Piece]:
    """Non-empty parts of ``text[start:end]`` between separators, as offsets."""
    if sep == "":
        return [(i, i + 1) for i in range(start, end)]
    out, at = [], start
    find_from = start
    while True:
        hit = text.find(sep, find_from, end)
        if hit < 0:
            break
        if hit > at:
            out.append((at, hit))
        at = hit if keep else hit + len(sep)
        find_from = hit + len(sep)
    if end > at:
        out.append((at, end))
    return out


def _pack(
    text: str, pieces: list[Piece], lengths: list[int], sep: str, size: int, overlap: int
) -> Iterator[tuple[str, int, int]]:
    """Pack consecutive pieces greedily up to ``size``, each pack repeating up to ``overlap``.

    Piece ``b`` fits a pack that started at ``a`` while
    ``sum(lengths[a..b]) + (b - a) * len(sep) <= size``. Both sides of that rule
    are running sums, so pack ends and overlap starts are binary searches.
    """
    n, gap = len(pieces), len(sep)
    before = [0, *accumulate(lengths)]                    # sum of lengths before i
    floor = [s + i * gap for i, s in enumerate(before)]   # before[i] + separators before i
    reach = [before[i + 1] + i * gap for i in range(n)]   # through piece i
    a, b = 0, 0
    while b < n:
        # first piece that no longer fits; the current one always joins an empty pack
        stop = max(bisect_right(reach, size + floor[a], b), b + 1 if a == b else b)
        if stop > a:
            chunk = _join(text, pieces, a, min(stop, n), sep)
            if stop >= n:
                if chunk:
                    yield chunk
                return
            if chunk:
                yield chunk
            total_end = before[stop]
            small = bisect_left(before, total_end - overlap, a, stop)
            fits = bisect_left(floor, reach[stop] - size, a, stop)
            empty = bisect_left(before, total_end, a, stop)
            a = max(a, small, min(fits, empty))
        b = stop


def _join(text: str, pieces: list[Piece], a: int, b: int, sep: str) -> tuple[str, int, int] | None:
    start, end = pieces[a][0], pieces[b - 1][1]
    joined = sep.join(text[s:e] for s, e in pieces[a:b])
    left = joined.lstrip(WS_CHARS)
    content = left.rstrip(WS_CHARS)
    if not content:
        return None
    return content, start + len(joined) - len(left), end - (len(left) - len(content))


def split_text(
    text: str,
    size: int,
    overlap: int,
    separators: Sequence[str] = ("\n\n", "\n", " ", ""),
    keep_separator: bool = False,
    length: Callable[[str], int] = len,
) -> Iterator[tuple[str, int, int]]:
    """Chunks of ``text`` as (content, start, end).

    The first separator present splits; parts under ``size`` are packed with
    overlap, larger ones are split again with the later separators.
    """

    def walk(start: int, end: int, seps: Sequence[str]) -> Iterator[tuple[str, int, int]]:
        sep, later = seps[-1], None
        for i, s in enumerate(seps):
            if s == "":
                sep = s
                break
            if text.find(s, start, end) >= 0:
                sep, later = s, seps[i + 1 :]
                break
        glue = "" if keep_separator else sep
        run: list[Piece] = []
        sizes: list[int] = []
        for p in _pieces(text, start, end, sep, keep_separator):
            n = p[1] - p[0] if length is len else length(text[p[0] : p[1]])
            if n < size:
                run.append(p)
                sizes.append(n)
                continue
            if run:
                yield from _pack(text, run, sizes, glue, size, overlap)
                run, sizes = [], []
            if later:
                yield from walk(p[0], p[1], later)
            else:
                yield text[p[0] : p[1]], p[0], p[1]
        if run:
            yield from _pack(text, run, sizes, glue, size, overlap)

    yield from walk(0, len(text), tuple(separators))


def split_column(
    text: Column | str,
    size: int = 1000,
    overlap: int = 100,
    separators: Sequence[str] = ("\n\n", "\n", " ", ""),
    keep_separator: bool = False,
    length: str | Callable[[str], int] = len,
    count: Callable[[str], int] | None = None,
) -> Column:
    """Chunk array of a text column; rows stay where they are, nothing is shuffled.

    ``length`` is a name (see :mod:`.lengths`) or a function. With ``count`` chunks have ``tokens``, what it says
    of their text: a chunk is counted where it is cut, and its text does not go to Python again.
    """
    length = length_function(length)
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < size")
    if not separators:
        raise ValueError("separators must not be empty")

    @F.arrow_udf(CHUNK_TYPE if count is None else COUNTED_CHUNK_TYPE)
    def split(texts: pa.Array) -> pa.Array:
        offsets, content, starts, ends = [0], [], [], []
        for text in texts.to_pylist():
            if text and text.strip(WS_CHARS):
                for c, s, e in split_text(text, size, overlap, separators, keep_separator, length):
                    content.append(c)
                    starts.append(s)
                    ends.append(e)
            offsets.append(len(content))
        fields = {"content": pa.array(content, pa.string()), "start_offset": pa.array(starts, pa.int32()), "end_offset": pa.array(ends, pa.int32())}
        if count is not None:
            fields["tokens"] = pa.array(map(count, content), pa.int32())
        rows = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return split(F.col(text) if isinstance(text, str) else text)
