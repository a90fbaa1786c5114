"""Column functions over raw HTML: checks, text, scores, titles, entities."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import NON_WS, WS, col, count_matches, let, replace_all, trim_ws, warnings_of
from .urls import host

MAX_HTML = 50 * 1024 * 1024

#: Script and style out, tags to spaces, white space to one space, no space
#: before sentence ends.
STRIP_STEPS = (
    (r"(?is)<script[^>]*>.*?</script>", ""),
    (r"(?is)<style[^>]*>.*?</style>", ""),
    (r"<[^>]+>", " "),
    (rf"{WS}+", " "),
    (r" ([.!?])", "$1"),
    (r"^ | $", ""),
)

P_TAG = r"(?i)<p[^>]*>"
H_TAG = r"(?i)<h[1-6][^>]*>"
LIST_TAG = r"(?i)<[uo]l[^>]*>"
A_TAG = r"(?i)<a[^>]*>"

HAS_DOCTYPE = rf"(?i)<!DOCTYPE{WS}+html"
HAS_HTML = rf"(?i)<html(?:{WS}|>)"
HAS_HEAD = rf"(?i)<head(?:{WS}|>)"
HAS_BODY = rf"(?i)<body(?:{WS}|>)"

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
BODY = r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body\s*>|$)"
COMMENT = r"(?s)<!--.*?-->"
# The close tag keeps its place, so that the element still counts once.
RAW_BODY = r"(?is)(<(?:script|style)\b[^>]*>).*?(</(?:script|style)\s*>)"
OPEN_TAG = r"<[a-zA-Z][^>]*>"
ANY_TAG = r"</?[a-zA-Z][^>]*>|<![^>]*>"

#: Named character references (HTML 4 set), from the standard library table.
ENTITIES = {name: chr(cp) for name, cp in name2codepoint.items()} | {"apos": "'"}
ENTITY = r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def char_of(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    safe = F.when(valid, code).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(text: Column | str) -> Column:
    """Resolve ``&name;``, ``&#n;`` and ``&#xh;``; unknown names stay as they are."""
    c = col(text)
    # one literal, folded once when the query is planned
    table = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def named(p: Column) -> Column:
        return F.struct(p.alias("p"), F.regexp_extract(p, ENTITY, 1).alias("name"))

    def valued(x: Column) -> Column:
        name = x["name"]
        # without leading zeros, of which there may be any number
        digits = F.concat(F.lit("0"), F.regexp_extract(name, "^#[xX]?0*([0-9a-fA-F]*)$", 1))
        code = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        char = F.when(name.startswith("#"), char_of(code.cast("long"))).otherwise(F.element_at(table, name))
        rest = F.substring(x["p"], F.length(name) + 2, F.length(x["p"]))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), x["p"]))

    def resolved(t: Column) -> Column:
        def joined(pieces: Column) -> Column:
            after_first = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))
            decoded = F.transform(F.transform(after_first, named), valued)
            return F.concat(F.element_at(pieces, 1), F.array_join(decoded, ""))

        return F.when(t.contains("&"), let(F.split(t, "&"), joined)).otherwise(t)

    return let(c, resolved)


def strip_to_text(html: Column | str) -> Column:
    return replace_all(F.coalesce(col(html), F.lit("")), STRIP_STEPS)


def content_score(text: Column, html: Column) -> Column:
    """min(len/100, 100) + 5 per paragraph + 3 per heading + 2 per list, less the link penalty."""
    length = F.length(text).cast("double")
    links = count_matches(html, A_TAG)
    link_ratio = links / F.greatest(length / 100.0, F.lit(1.0))
    score = (
        F.least(length / 100.0, F.lit(100.0))
        + count_matches(html, P_TAG) * 5
        + count_matches(html, H_TAG) * 3
        + count_matches(html, LIST_TAG) * 2
        - F.when(link_ratio > 5, link_ratio * 2).otherwise(0.0)
    )
    return F.greatest(score, F.lit(0.0))


def excerpt(text: Column | str, limit: int = 200) -> Column:
    """At most ``limit`` characters, cut at a sentence end or a space if one is late enough."""
    c = col(text)
    head = F.substring(c, 1, limit)
    # 0-based place of the last occurrence, -1 where there is none
    last_dot = F.when(head.contains("."), limit - F.locate(".", F.reverse(head))).otherwise(-1)
    last_space = F.when(head.contains(" "), limit - F.locate(" ", F.reverse(head))).otherwise(-1)
    return (
        F.when(F.length(c) <= limit, c)
        .when(last_dot > limit * 0.5, F.substring(c, F.lit(1), last_dot + 1))
        .when(last_space > limit * 0.7, F.concat(F.substring(c, F.lit(1), last_space), F.lit("...")))
        .otherwise(F.concat(head, F.lit("...")))
    )


def read_time(text_length: Column, fallback: Column) -> Column:
    """Characters for the primary pick, started thousands of characters for a fallback."""
    return F.when(fallback, F.ceil(text_length / 1000.0)).otherwise(text_length).cast("long")


def html_error(html: Column | str) -> Column:
    """Why html is not valid, NULL where it is."""
    c = F.coalesce(col(html), F.lit(""))
    return (
        F.when(col(html).isNull(), "HTML content must be a string")
        .when(~c.rlike(NON_WS), "HTML content cannot be empty")
        .when(
            F.length(c) > MAX_HTML,
            F.concat(
                F.lit("HTML content too large: "), F.length(c).cast("string"),
                F.lit(" bytes (max 50MB)"),
            ),
        )
    )


def validity(html: Column | str) -> Column:
    """Struct of validity, error, length, structure flags and warnings."""
    c = F.coalesce(col(html), F.lit(""))
    has_head, has_body = c.rlike(HAS_HEAD), c.rlike(HAS_BODY)
    error = html_error(html)
    checked = error.isNull()
    return F.struct(
        checked.alias("valid"),
        error.alias("error"),
        F.length(c).cast("long").alias("length"),
        (checked & c.rlike(HAS_DOCTYPE)).alias("has_doctype"),
        (checked & c.rlike(HAS_HTML)).alias("has_html"),
        (checked & has_head).alias("has_head"),
        (checked & has_body).alias("has_body"),
        warnings_of(
            (checked & ~has_body, "HTML content missing <body> tag"),
            (checked & ~has_head, "HTML content missing <head> tag"),
        ).alias("warnings"),
    )


def body_text(html: Column | str) -> Column:
    """Text content of the body, white space kept, references resolved."""
    body = F.regexp_extract(F.regexp_replace(col(html), COMMENT, ""), BODY, 1)
    return decode_entities(F.regexp_replace(body, ANY_TAG, ""))


def title_tag(html: Column | str) -> Column:
    """Text of ``<title>`` with white space squeezed; '' where there is none."""
    raw = decode_entities(F.regexp_extract(col(html), TITLE, 1))
    return trim_ws(F.regexp_replace(raw, f"{WS}+", " "))


def element_count(html: Column | str) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(col(html), COMMENT, ""), RAW_BODY, "$1$2")
    return count_matches(cleaned, OPEN_TAG)


def page_title(html: Column | str, url: Column | str) -> Column:
    """``<title>``, else the domain, else ``Unknown``."""
    return title_or_domain(title_tag(html), url)


def title_or_domain(title: Column, url: Column | str) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(host(url), F.lit("")), F.lit("Unknown"))


def raw_attribute(tag: Column | str, name: str) -> Column:
    """Value of an attribute of one raw tag as it is written; NULL where it is absent."""
    rx = rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    value = F.regexp_extract(col(tag), rx, 1)
    return F.regexp_replace(F.nullif(value, F.lit("")), "^[\"']|[\"']$", "")


def attribute(tag: Column | str, name: str) -> Column:
    """Value of an attribute with references resolved; NULL where it is absent."""
    return decode_entities(raw_attribute(tag, name))


def meta_content(html: Column | str, name: str) -> Column:
    """Content of ``<meta name=...>`` (or ``property=og:...``), '' where there is none."""
    tag = F.regexp_extract(
        col(html), rf"""(?is)<meta\s[^>]*(?:name|property)\s*=\s*["']?(?:og:)?{name}["'\s/>][^>]*>?""", 0
    )
    return F.coalesce(trim_ws(attribute(tag, "content")), F.lit(""))


def stats(html: Column | str) -> Column:
    return F.struct(
        F.length(col(html)).cast("long").alias("html_length"),
        title_tag(html).alias("title"),
        element_count(html).alias("element_count"),
        F.length(body_text(html)).cast("long").alias("text_length"),
    )
