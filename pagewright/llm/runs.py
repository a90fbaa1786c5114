"""Periodic runs of words in whole texts, found from Lyndon roots.

A run is a stretch of words with smallest period q that no neighbour extends. Every run with two periods or
more holds a Lyndon word of length q which is the longest Lyndon word at its place, for the order of the
words or for the reverse order. Phase one of Baier's suffix sorter groups the suffixes of a text by just
these words, so it is run once for each order (:func:`lyndon_lengths`); every place with its length is a root,
and how far it repeats to both sides is two queries for the longest common extension, answered
from names of all blocks of 1, 2, 4, ... words (:class:`Extensions`).

Sorting is Python work, so texts are narrowed first, without losing a run: in a run of at least
``min_length`` words and ``min_exponent`` periods every stretch of :func:`narrowing` words occurs
again a period away, so a place at which no stretch repeats in the text stands in no run. Equal hashes only
keep too much. What is left is sorted and extended exactly.

Words are what stands between ASCII white space, compared as bytes. Null and empty texts have no words, no runs
and an empty collapsed text. Rows are independent: equal or null ids, repeated rows and extra columns of any
name pass through. Texts are taken in portions of ``PORTION_BYTES``, or one text if that is longer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import add_columns

MIN_LENGTH, MIN_EXPONENT = 24, 3
PORTION_BYTES = 1 << 21
_RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by grouping the suffixes.

    Suffixes start out grouped by their first word. Groups are taken from the greatest down. Each member looks
    for the nearest place before it whose group is less; there the word of that group goes on with the
    member's word, as often as members look to it. Such places leave their group for a new one, directly
    behind it. Groups are stretches of ``order``, named by where they begin, so names compare as groups do.
    """
    n = len(ranks)
    order = sorted(range(n), key=ranks.__getitem__)
    place, group, before, length = [0] * n, [0] * n, [0] * n, [0] * n
    end, size = {}, {}
    first = 0
    for k, i in enumerate(order):
        place[i] = k
        if ranks[i] != ranks[order[first]]:
            first = k
        group[i] = first
        end[first], size[first] = k + 1, 1
    top = n
    while top:
        g = group[order[top - 1]]
        word = size[g]
        looked: dict[int, int] = {}
        for i in sorted(order[g:top]):
            length[i] = word
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                looked[j] = looked.get(j, 0) + 1
        top = g
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, times in looked.items():
            by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(by_times, reverse=True):
            for old, moved in by_times[times].items():
                stop = end[old]
                new = stop - len(moved)
                if new > old:
                    at = stop
                    for j in moved:
                        at -= 1
                        other, here = order[at], place[j]
                        order[at], order[here] = j, other
                        place[j], place[other] = at, here
                        group[j] = new
                    end[new], end[old] = stop, new
                size[new] = size[old] + times * word
    return length


class Extensions:
    """Longest common extensions between places of one array, exactly: equal blocks have equal names."""

    def __init__(self, words: np.ndarray, longest: int):
        self.names = [words]
        while 2 << (len(self.names) - 1) <= longest:
            half, last = 1 << (len(self.names) - 1), self.names[-1]
            pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def _extend(self, a: np.ndarray, b: np.ndarray, ahead: bool) -> np.ndarray:
        """Words that are equal from ``a`` and ``b`` on, or up to before them. ``a`` stands before ``b``."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step, name = 1 << k, self.names[k]
            x, y = (a + found, b + found) if ahead else (a - found - step, b - found - step)
            fits = (y < len(name)) & (x >= 0)
            same = np.zeros(len(a), bool)
            same[fits] = name[x[fits]] == name[y[fits]]
            found += same * step
        return found

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extend(a, b, True)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extend(a, b, False)


def narrowing(min_length: int, min_exponent: int) -> int:
    """Words of which a stretch must repeat: of a run with period q, the places of all stretches are at least 2q."""
    return min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2))


def _stretches(words: np.ndarray, ends: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """Parts (start, end) of ``words`` in which all stretches of ``width`` words repeat in their text; of ``least``
    words or more. Text d ends before ``ends[d]``."""
    n = len(words) - width + 1
    if n < 1:
        return []
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    with np.errstate(over="ignore"):
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        value = (text[:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
        for k in range(width):
            value = value * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(value)
    same = np.diff(value[order]) == 0
    often = np.zeros(n + 2, bool)
    often[order[1:][same] + 1] = True
    often[order[:-1][same] + 1] = True
    often[1:-1] &= text[:n] == text[width - 1 :]
    edges = np.flatnonzero(often[1:] != often[:-1]).reshape(-1, 2)
    # Starts on both sides of the end of a text are not both marked: those between do not fit into one.
    keep = edges[:, 1] - edges[:, 0] + width - 1 >= least
    return [(int(a), int(b) + width - 1) for a, b in edges[keep]]


def runs_of_words(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Rows (start, length, period) of each text, by start, then period."""
    names: dict[bytes, int] = {}
    for words in texts:
        for w in words:
            if w not in names:
                names[w] = len(names)
    ends = np.cumsum([len(w) for w in texts], dtype=np.int64)
    every = np.fromiter((names[w] for words in texts for w in words), np.int32, int(ends[-1]) if texts else 0)
    width = narrowing(min_length, min_exponent)
    parts = _stretches(every, ends, width, min_length) if width > 1 else [
        (int(e - len(w)), int(e)) for w, e in zip(texts, ends) if len(w) >= min_length
    ]
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    if not parts:
        return out
    # The parts in a row, each followed by a word of its own, so that nothing extends from one into the next.
    joined, at, period = [], [], []
    base = 0
    for k, (a, b) in enumerate(parts):
        words = every[a:b]
        ranks = np.unique(words, return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            at.append(np.arange(base, base + b - a))
            period.append(np.array(lyndon_lengths(order.tolist()), np.int64))
        joined += [words, np.array([len(names) + k], np.int32)]
        base += b - a + 1
    extensions = Extensions(np.concatenate(joined), max(b - a for a, b in parts))
    start, q = np.unique(np.stack([np.concatenate(at), np.concatenate(period)], 1), axis=0).T
    behind = extensions.behind(start, start + q)
    length = behind + q + extensions.ahead(start, start + q)
    long = length >= np.maximum(min_length, min_exponent * q)
    found = np.unique(np.stack([(start - behind)[long], q[long], length[long]], 1), axis=0)
    # Back to places in the texts.
    bases = np.cumsum([0] + [b - a + 1 for a, b in parts[:-1]])
    part = np.searchsorted(bases, found[:, 0], "right") - 1
    place = found[:, 0] - bases[part] + np.array([a for a, _ in parts])[part]
    text = np.searchsorted(ends, place, "right")
    found[:, 0] = place - np.concatenate([[0], ends])[text]
    cuts = np.flatnonzero(np.diff(text)) + 1
    for rows, d in zip(np.split(found, cuts), text[np.concatenate([[0], cuts])] if len(text) else []):
        out[d] = rows[:, [0, 2, 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, without those a run holds after its first period."""
    if len(runs):
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
        np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
        gone = np.cumsum(marks)
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` as columns ``_0``, ``_1``, ... in order, without change, then ``n_words``, ``runs`` (start, length and
    period in words, by start, then period), ``collapsed`` (the text without what its runs repeat, its words
    joined by a space) and ``collapsed_sha256``. ``min_length`` is 2 or more, ``min_exponent`` a whole number from 2."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have two periods or more")

    def make(texts: list[bytes]) -> list[pa.Array]:
        counts, starts, lengths, periods, pressed = [], [], [], [], []
        some: list[list[bytes]] = []
        size = 0
        for k, t in enumerate(texts):
            some.append(t.split())
            size += len(t)
            if size < PORTION_BYTES and k + 1 < len(texts):
                continue
            for words, runs in zip(some, runs_of_words(some, min_length, min_exponent)):
                counts.append((len(words), len(runs)))
                starts.append(runs[:, 0])
                lengths.append(runs[:, 1])
                periods.append(runs[:, 2])
                pressed.append(collapsed(words, runs))
            some, size = [], 0
        n_words, n_runs = zip(*counts) if counts else ((), ())
        values = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (starts, lengths, periods)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int32))
        found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, ["start", "length", "period"]))
        digests = pa.array([hashlib.sha256(t).hexdigest() for t in pressed], pa.string())
        return [pa.array(n_words, pa.int64()), found, pa.array(pressed, pa.binary()).cast(pa.string()), digests]

    return add_columns(docs, text, f"n_words bigint, runs {_RUN}, collapsed string, collapsed_sha256 string", make)


def greatest(runs: Column) -> Column:
    """The run of the greatest exact exponent; of equal ones that of the least start, then the least period."""
    none = F.lit(None).cast(_RUN.removeprefix("array<").removesuffix(">"))

    def better(a: Column, b: Column) -> Column:
        left, right = a.length * b.period, b.length * a.period
        first = (b.start < a.start) | ((b.start == a.start) & (b.period < a.period))
        return F.when(a.isNull() | (right > left) | ((right == left) & first), b).otherwise(a)

    return F.reduce(runs, none, better)


def with_loops(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the ends of about a tenth of the texts made to repeat, as a hash of the id decides:
    h = crc32(id) divisible by 10 has word i >= a replaced by word a + (i - a) % p, where a = (h // 10) % n and
    p = 1 + (n - a) // (3 + (h // 10) % 8). A null id has no hash; its text stays."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.split(F.btrim(value, F.lit("\t\n\u000b\f\r ")), "[ \\t\\n\\x0B\\f\\r]+", -1)

    def looped(h: Column, words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        tail = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(tail, times))), F.lit(1), n.cast("int")), " ")

    h = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & value.rlike("[^ \\t\\n\\x0B\\f\\r]")
    once = F.transform(F.array(words), lambda w: looped(h, w))[0]
    made = F.when(chosen, once).otherwise(F.col(f"`{text}`"))
    return docs.select(*[made.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
