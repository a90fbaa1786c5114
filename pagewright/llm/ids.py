"""Token ids of whole texts, for use inside Spark tasks.

The public word BPE lower-cases, cuts a text into words, digits and signs, and never looks across their ends or
white space, so the ids of a text are those of its parts in a row. Arrow splits a group of texts at white space and
names the different chunks; only these are cut into parts, named again, and looked up; the ids of the texts are
gathered from theirs by array arithmetic. Each worker keeps the ids of parts it has met, in two
generations of bounded bytes, and asks the tokenizer's model only about new ones. Chunks with characters
that need normalising go to the whole tokenizer. So do texts, where the vocabulary has any other build.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes, about, that a worker keeps in each generation of its cache.
CACHE_BYTES = 16 << 20
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Texts are encoded in groups of about so many bytes, so that the arrays of a group stay small.
GROUP_BYTES = 4 << 20
#: Words whose ids are gathered at a time.
GATHER_WORDS = 1 << 17

# Chunks of these characters need no normalising beyond str.lower(), and split alike in both libraries.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*\Z")
# White space is written out: the tokenizer's \s has no U+001C to U+001F, that of Python's str has.
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t-\ra-zß-öø-ÿ0-9]+|\n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> dict[int, str]:
    """What byte-level vocabularies write for bytes that have no printable character: those from U+0100 on, in order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_CHARACTERS = _byte_characters()


class _Kept:
    """A dictionary in two generations: the older one goes when the newer one is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old, self.size = limit, {}, {}, 0

    def put(self, part: str, ids: bytes) -> None:
        self.new[part] = ids
        self.size += len(part) + len(ids) + ENTRY_BYTES

    def turn(self) -> None:
        if self.size >= self.limit:
            self.old, self.new, self.size = self.new, {}, 0


class Encoder:
    """Texts (UTF-8 bytes) to ids; ids come as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.by_word = _splits_at_white_space(path)
        self.model = self.tokenizer.model
        self.pack = lambda ids: struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)
        self.parts = _Kept(cache_bytes)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in found]
        out: list[bytes] = []
        first, size = 0, 0
        for k, t in enumerate(texts, 1):
            size += len(t)
            if size >= GROUP_BYTES or k == len(texts):
                out += self._group(texts[first:k])
                first, size = k, 0
        return out

    def _group(self, texts: list[bytes]) -> list[bytes]:
        self.parts.turn()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        named = split.flatten().dictionary_encode()
        ids, sizes = self._chunks(named.dictionary)
        first = np.cumsum(sizes) - sizes
        at = named.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(sizes[at])])
        every = np.empty(before[-1], self.dtype)
        for a in range(0, len(at), GATHER_WORDS):
            some = at[a : a + GATHER_WORDS]
            start, stop = before[a], before[a + len(some)]
            every[start:stop] = ids[np.arange(start, stop) + np.repeat(first[some] - before[a : a + len(some)], sizes[some])]
        stops = before[split.offsets.to_numpy()].tolist()
        return [every[a:b].tobytes() for a, b in zip(stops, stops[1:])]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks in a row, and how many each has."""
        if not len(chunks):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), "\n")[0].as_py() + "\n"
        if "<|" not in lines and _PLAIN.match(lines):
            parts = _PARTS.findall(lines.lower())
        else:
            parts = []
            for chunk in lines[:-1].split("\n"):
                plain = "<|" not in chunk and _PLAIN.match(chunk)
                # A space before it marks what the whole tokenizer is to cut.
                parts += [*_PARTS.findall(chunk.lower()), "\n"] if plain else [" " + chunk, "\n"]
        ids = self._known(parts)
        upto = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // self.dtype.itemsize
        # Each chunk ends with a line feed, which has no ids.
        ends = upto[np.fromiter(map("\n".__eq__, parts), bool, len(parts))]
        return np.frombuffer(b"".join(ids), self.dtype), np.diff(ends, prepend=0)

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of each part."""
        new, old = self.parts.new, self.parts.old
        found = list(map(new.get, parts))
        if None in found:
            for part in {p for p, ids in zip(parts, found) if ids is None}:
                ids = old.get(part)
                self.parts.put(part, self._ask(part) if ids is None else ids)
            found = list(map(new.__getitem__, parts))
        return found

    def _ask(self, part: str) -> bytes:
        if part == "\n":
            return b""
        if part[0] == " ":
            return self._ids(part[1:]).tobytes()
        # The model writes the bytes of a part as characters.
        plain = part.isascii() and part.isprintable()
        tokens = self.model.tokenize(part if plain else part.encode().decode("latin-1").translate(_BYTE_CHARACTERS))
        return self.pack([t.id for t in tokens])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)


def _splits_at_white_space(path: str) -> bool:
    """Whether the file has the normaliser and splitter that the word caches rely on."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = [s.get("type") for s in (made.get("normalizer") or {}).get("normalizers", [])]
    cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = cuts[0].get("pattern", {}).get("Regex") if cuts else None
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and made["model"].get("end_of_word_suffix") == "</w>"
    )


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release(keep: str | None = None) -> None:
    """Give back what earlier tasks of this worker hold: encoders but that of ``keep``, Arrow's pool, and free
    memory of the C library. Spark runs tasks of other steps in the same worker processes."""
    for path in [p for p in _ENCODERS if p != keep]:
        del _ENCODERS[path]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its free memory
        pass
