"""Plain Python statements of what the operators compute, for small tables."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def contamination(text, items, size=13):
    """(words, hit words, sorted item ids) of one text."""
    words = benchmark_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        mine = benchmark_words(item_text)
        for i in range(max(1, len(mine) - size + 1) if mine else 0):
            window = mine[i : i + size]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(size))))


def components(documents):
    """(doc_id, set size, least doc id reached) per (doc_id, text) row."""
    sets = [shingles(t) for _, t in documents]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            common = len(a & sets[k])
            if a and sets[k] and 100 * common >= 90 * (len(a) + len(sets[k]) - common):
                root[find(i)] = find(k)
    least = {}
    for i, (doc, _) in enumerate(documents):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(documents, sets))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(names):
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def dedup_lines(texts, min_docs):
    """(kept text, lines, lines dropped) of each text."""
    white = " \t\n\x0b\f\r"
    split = [[(line, line.strip(white).translate(_LOWER)) for line in (t or "").split("\n")] for t in texts]
    seen = {}
    for lines in split:
        for key in {k for _, k in lines}:
            seen[key] = seen.get(key, 0) + 1
    out = []
    for lines in split:
        kept = [line for line, key in lines if not key or seen[key] < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def runs(words, min_length=24, min_exponent=3):
    """(start, length, period) of all runs, by comparing all places with those a period away."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        s = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                s = i if s is None else s
            elif s is not None:
                length = i - s + q
                part = words[s : s + length]
                smaller = any(part[p:] == part[:-p] for p in range(1, q))
                if length >= max(min_length, min_exponent * q) and not smaller:
                    out.append((s, length, q))
                s = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc_id, text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_row(doc_id, text):
    """The row of op12 for one document, but its id."""
    words = looped(doc_id, text)
    found = runs(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def damaged(rows):
    """(conv_id, turn, role, text) rows with the planted faults."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation after damage, by trying
    all edits in which a row is kept, rerolled or deleted after up to two insertions."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.sub(r"[ \t-\r]", "", text)[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    best = {"": (0, "", ())}

    def add(table, shape, path):
        if re.fullmatch("(s?(ua)*u?)?", shape):
            shape = shape if len(shape) < 3 else shape[0].replace("u", "") + ("ua" if shape[-1] == "a" else "uau")
            if shape not in table or path < table[shape]:
                table[shape] = path

    def with_inserts(table):
        for _ in range(2):
            for shape, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    add(table, shape + role[0], (cost + 5, audit + "I", (*out, role + ":")))
        return table

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for shape, (cost, audit, out) in with_inserts(best).items():
            add(new, shape, (cost + 2, audit + "D", out))
            if fault in (0, 3):
                more = cost + (5 if fault else 0)
                for to in ("user", "assistant"):
                    add(new, shape + to[0], (more + 1, audit + "R", (*out, f"{to}:{text}")))
                if role[:1] in ("s", "u", "a"):
                    add(new, shape + role[:1], (more, audit + "K", (*out, f"{role}:{text}")))
        best = new
    cost, audit, out = min(v for k, v in with_inserts(best).items() if re.fullmatch("(s?(ua)+)?", k))
    counts = [faults.count(k) for k in (1, 2, 3)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
