"""Column functions over chunk text: clean-up, counts, structure, readability, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import NON_WS, WS, col, count_matches, ratio, replace_all, round_half_up, warnings_of
from .markdown import FENCE, IMAGE, LINK, SPACE_FENCES, SPACE_HEADINGS, TABLE_ROW

# Patterns and replacements of the clean-up, in order, and of what is counted.
CLEAN_STEPS = (
    (r"\r\n", "\n"),
    (r"\r", "\n"),
    (r"[ \t]+", " "),
    (r"\n{4,}", "\n\n\n"),
    *SPACE_HEADINGS,
    *SPACE_FENCES,
)

STRUCTURE_PATTERNS = {
    "h1": r"(?m)^# ",
    "h2": r"(?m)^## ",
    "h3": r"(?m)^### ",
    "h4": r"(?m)^#### ",
    "h5": r"(?m)^##### ",
    "h6": r"(?m)^###### ",
    "headings": r"(?m)^#{1,6} ",
    "unordered": rf"(?m)^{WS}*[-*+] ",
    "ordered": rf"(?m)^{WS}*[0-9]+\. ",
    "fences": FENCE,
    "inline_code": r"`[^`]+`",
    "links": LINK,
    "images": IMAGE,
    "tables": TABLE_ROW,
    "blockquotes": r"(?m)^>",
}

NOT_WORD = r"[^a-zA-Z0-9_]+"
SENTENCE_END = r"[.!?]+"


def clean(text: Column | str) -> Column:
    """Line ends, spaces, blank lines, and space around headings and fences."""
    return replace_all(text, CLEAN_STEPS)


def clean_warnings(text: Column, cleaned: Column) -> Column:
    blocks = count_matches(cleaned, FENCE) / 2.0
    # whole numbers are written without a fraction
    shown = F.when(blocks == F.floor(blocks), blocks.cast("long").cast("string")).otherwise(
        blocks.cast("string")
    )
    return warnings_of(
        (
            F.length(cleaned) < F.length(text) * 0.8,
            "Significant text reduction during preprocessing",
        ),
        (
            blocks > 10,
            F.concat(
                F.lit("Many code blocks detected ("), shown, F.lit(") - chunking may split code")
            ),
        ),
    )


def word_count(text: Column | str) -> Column:
    """Runs of ASCII letters, digits and ``_``.

    Everything else separates words, white space and punctuation alike, so
    counting the runs equals blanking punctuation, splitting and dropping
    empties, without building an array.
    """
    return F.coalesce(count_matches(text, r"[a-zA-Z0-9_]+"), F.lit(0)).cast("long")


def line_count(text: Column | str) -> Column:
    return count_matches(text, "\n") + 1


def paragraph_count(text: Column | str) -> Column:
    parts = F.split(col(text), "\n\n")
    return F.size(F.filter(parts, lambda p: p.rlike(NON_WS))).cast("long")


def structure(text: Column | str) -> Column:
    c = col(text)
    n = {name: count_matches(c, rx) for name, rx in STRUCTURE_PATTERNS.items()}
    return F.struct(
        F.struct(
            *[n[h].alias(h) for h in ("h1", "h2", "h3", "h4", "h5", "h6")],
            n["headings"].alias("total"),
        ).alias("headings"),
        F.struct(n["unordered"].alias("unordered"), n["ordered"].alias("ordered")).alias("lists"),
        (n["fences"] / 2.0).alias("code_blocks"),
        *[n[k].alias(k) for k in ("inline_code", "links", "images", "tables", "blockquotes")],
    )


def content_type(s: Column) -> Column:
    """Kind of text from its structure counts, first rule that fits."""
    return (
        F.when((s["code_blocks"] > 3) | (s["inline_code"] > 10), "technical-documentation")
        .when(s["headings"]["total"] > 3, "structured-document")
        .when(s["lists"]["unordered"] + s["lists"]["ordered"] > 5, "list-heavy")
        .when(s["tables"] > 2, "data-heavy")
        .otherwise("general-text")
    )


def readability(text: Column | str, words: Column | None = None) -> Column:
    c = col(text)
    words = word_count(c) if words is None else words
    sentences = F.size(F.filter(F.split(c, SENTENCE_END), lambda s: s.rlike(NON_WS)))
    # Most white space is spaces, which need no pattern.
    characters = F.length(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), WS, ""))
    return F.struct(
        round_half_up(ratio(words, sentences), 1).alias("words_per_sentence"),
        round_half_up(ratio(characters, words), 1).alias("characters_per_word"),
        F.ceil(words / 200.0).cast("long").alias("reading_minutes"),
    )


def analysis(text: Column | str, s: Column, words: Column) -> Column:
    """Content metadata of a text from its structure ``s`` and word count ``words``."""
    c = col(text)
    return F.struct(
        F.length(c).cast("long").alias("length"),
        words.alias("word_count"),
        line_count(c).alias("line_count"),
        paragraph_count(c).alias("paragraph_count"),
        s.alias("structure"),
        content_type(s).alias("content_type"),
        readability(c, words).alias("readability"),
    )


def hash36(text: Column | str) -> Column:
    """32-bit 31-multiplier hash over UTF-16 units, absolute value in base 36."""
    two32 = F.lit(4294967296)

    def step(h: Column, ch: Column) -> Column:
        cp = F.ascii(ch).cast("long")
        high = F.lit(0xD800) + F.floor((cp - 0x10000) / 1024).cast("long")
        low = F.lit(0xDC00) + (cp - 0x10000) % 1024
        return F.when(cp > 0xFFFF, (((h * 31 + high) % two32) * 31 + low) % two32).otherwise(
            (h * 31 + cp) % two32
        )

    c = col(text)
    units = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    h = F.aggregate(units, F.lit(0).cast("long"), step)
    signed = F.abs(F.when(h >= 2147483648, h - two32).otherwise(h))
    return F.lower(F.conv(signed.cast("string"), 10, 36))


def chunk_id(url: Column | str, index: Column | str, content: Column | str) -> Column:
    source = F.coalesce(F.when(col(url) != "", col(url)), F.lit("unknown"))
    return F.concat(
        F.lit("chunk_"), hash36(source), F.lit("_"), col(index).cast("string"), F.lit("_"),
        hash36(F.substring(col(content), 1, 100)),
    )


def chunk_key(url: Column | str, index: Column | str, content: Column | str) -> Column:
    """A key of 128 bits over the whole of a chunk and where it comes from, as 32 hex digits.

    The short ids of :func:`chunk_id` hold two hashes of 32 bits, which collide in large corpora; this one
    is what to join by. The parts are set apart by lengths, so no two lists of parts give the same text.
    """
    source, body = F.coalesce(col(url), F.lit("")), F.coalesce(col(content), F.lit(""))
    return F.md5(F.concat_ws(":", F.length(source).cast("string"), source, col(index).cast("string"), body).cast("binary"))


def preview(text: Column | str, limit: int = 200) -> Column:
    c = col(text)
    return F.concat(
        F.substring(c, 1, limit), F.when(F.length(c) > limit, "...").otherwise("")
    )
