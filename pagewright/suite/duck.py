"""DuckDB SQL snippets that say what the column functions say."""

from __future__ import annotations

import re

from ..functions import html as H
from ..functions import markdown as M
from ..functions import core
from ..functions.core import EDGE_WS, NON_WS, WS

# RE2 has neither intersections nor nested classes.
RE2_WS, RE2_NON_WS = f"[{core.WS_SET}]", f"[^{core.WS_SET}]"


def q(s: str) -> str:
    s = s.replace(WS, RE2_WS).replace(NON_WS, RE2_NON_WS)
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, replacement: str = "") -> str:
    r = re.sub(r"\$([0-9])", r"\\\1", replacement)
    return f"regexp_replace({x}, {q(pattern)}, {q(r)}, 'g')"


def steps(x: str, pairs) -> str:
    for p, r in pairs:
        x = sub(x, p, r)
    return x


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def ext(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def cnt(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def trim_ws(x: str) -> str:
    return sub(x, EDGE_WS)


def round_to(x: str, places: int) -> str:
    s = f"{10**places}::DOUBLE"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


def case_join(*pairs: tuple[str, str]) -> str:
    """Messages whose condition holds, joined by ``; `` ('' for none)."""
    items = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in pairs)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '; ')"


# URLs: scheme, user part, host (a name or a bracketed address), port, path, query, fragment
_URL = (
    "^([hH][tT][tT][pP][sS]?)://((?:[^/?#@[:space:]]*@)?)([[][0-9a-fA-F:.]+[]]|[^]/?#:@[[:space:]]+)(?::([0-9]*))?"
    "((?:/[^?#]*)?)((?:[?][^#]*)?)(?:#.*)?$"
)
# Characters that are carried percent-encoded: outside printable ASCII, and a few within.
_UNSAFE = "[^!-~]|[\"<>`{}]"


def u_valid(x):
    return f"coalesce({has(x, _URL)}, false)"


def u_scheme(x):
    return f"lower({ext(x, _URL, 1)})"


def u_host(x):
    return f"coalesce(lower({ext(x, _URL, 3)}), '')"


def u_path(x):
    p = ext(x, _URL, 5)
    return f"CASE WHEN {u_valid(x)} THEN CASE WHEN {p} = '' THEN '/' ELSE {p} END ELSE '' END"


def u_port(x):
    p = ext(x, _URL, 4)
    return (
        f"CASE WHEN {p} = '' OR {p} = CASE WHEN {u_scheme(x)} = 'https' THEN '443' ELSE '80' END "
        f"THEN '' ELSE ':' || {p} END"
    )


def u_origin(x):
    return f"CASE WHEN {u_valid(x)} THEN {u_scheme(x)} || '://' || {u_host(x)} || {u_port(x)} END"


def u_encode(x):
    return (
        f"array_to_string(list_transform(str_split({x}, ''), lambda ch: CASE WHEN {has('ch', _UNSAFE)} "
        f"THEN {sub('hex(ch)', '(..)', '%$1')} ELSE ch END), '')"
    )


def u_norm(x):
    """Normal form (the test tables hold no dot segments)."""
    query = sub(ext(x, _URL, 6), r"^\?$")
    return (
        f"CASE WHEN {u_valid(x)} THEN {u_scheme(x)} || '://' || {ext(x, _URL, 2)} || {u_host(x)} || "
        f"{u_port(x)} || {u_encode(u_path(x))} || {u_encode(query)} ELSE {x} END"
    )


def u_drop(x):
    rx = "^(utm_[^=]*|ref|source)(=|$)"
    kept = (
        f"array_to_string(list_filter(str_split({ext(x, r'^[^?#]*[?]([^#]*)', 1)}, '&'), "
        f"lambda p: p <> '' AND NOT {has('p', rx)}), '&')"
    )
    return (
        f"{ext(x, '^([^?#]*)', 1)} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END || "
        f"{ext(x, '^[^#]*(#.*)?$', 1)}"
    )


def u_depth(x):
    return (
        f"CASE WHEN {u_valid(x)} THEN len(list_filter(str_split({u_path(x)}, '/'), lambda s: s <> '')) ELSE 0 END"
    )


# What each glob of the checked queries means, written by hand. A last slash does not count.
GLOBS = {
    "**": "true",
    "https://**": "{x} LIKE 'https://%'",
    "http://www.*/en/**": "regexp_matches({x}, '^http://www[.][^/]*/en/')",
    # two stars count as one unless they stand alone between slashes
    "http://{blog,m}.**": "regexp_matches({x}, '^http://(blog|m)[.][^/]*$')",
    "**/*.html": "regexp_matches({x}, '/[^/]*[.]html/?$')",
    "**/{es,fr}/[1-4]*": "regexp_matches({x}, '/(es|fr)/[1-4][^/]*/?$')",
} | {
    f"**/*.{e}": "rtrim({x}, '/') LIKE '%." + e + "'"
    for e in ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "tar.gz", "exe", "dmg")
}


def globs(x, patterns):
    if not patterns:
        return "false"
    return "(" + " OR ".join(GLOBS[g].format(x=x) for g in patterns) + ")"


def admission(x, depth, max_depth, include, exclude):
    return (
        f"CASE WHEN {depth} >= {max_depth} THEN 'depth_exceeded' WHEN {globs(x, exclude)} THEN 'excluded_pattern' "
        f"WHEN NOT {globs(x, include)} THEN 'not_included' ELSE 'allowed' END"
    )


# HTML
def strip(x):
    return steps(x, H.STRIP_STEPS)


def decode(x):
    """Resolve character references with the same table of names."""
    names = ", ".join(q(k) for k in H.ENTITIES)
    values = ", ".join(q(v) for v in H.ENTITIES.values())
    name = ext("p", H.ENTITY, 1)
    dec, hexa = ext(name, "^#([0-9]+)$", 1), ext(name, "^#[xX]([0-9a-fA-F]+)$", 1)
    value = (
        f"CASE WHEN {dec} <> '' THEN chr({dec}::INTEGER) WHEN {hexa} <> '' THEN chr(('0x' || {hexa})::INTEGER) "
        f"ELSE map([{names}], [{values}])[{name}] END"
    )
    return (
        f"array_to_string(list_transform(str_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
        f"WHEN {name} = '' OR ({value}) IS NULL THEN '&' || p ELSE ({value}) || substr(p, length({name}) + 2) END), '')"
    )


def title(x):
    return trim_ws(sub(decode(ext(x, H.TITLE, 1)), f"{WS}+", " "))


def body_text(x):
    return decode(sub(ext(sub(x, H.COMMENT), H.BODY, 1), H.ANY_TAG))


def score(text, html):
    links = cnt(html, H.A_TAG)
    r = f"({links} / greatest(length({text}) / 100.0::DOUBLE, 1.0::DOUBLE))"
    return (
        f"greatest(least(length({text})::DOUBLE / 100, 100.0::DOUBLE) + {cnt(html, H.P_TAG)} * 5 + "
        f"{cnt(html, H.H_TAG)} * 3 + {cnt(html, H.LIST_TAG)} * 2 - CASE WHEN {r} > 5 THEN {r} * 2 ELSE 0.0::DOUBLE END, "
        f"0.0::DOUBLE)"
    )


def excerpt(x, n=200):
    head = f"substr({x}, 1, {n})"
    dot = f"CASE WHEN contains({head}, '.') THEN {n} - instr(reverse({head}), '.') ELSE -1 END"
    space = f"CASE WHEN contains({head}, ' ') THEN {n} - instr(reverse({head}), ' ') ELSE -1 END"
    return (
        f"CASE WHEN length({x}) <= {n} THEN {x} WHEN {dot} > {n} * 0.5 THEN substr({x}, 1, ({dot}) + 1) "
        f"WHEN {space} > {n} * 0.7 THEN substr({x}, 1, {space}) || '...' ELSE {head} || '...' END"
    )


# Markdown and text
def plain(x):
    return steps(x, M.TEXT_STEPS)


def clean(x):
    """Line ends, runs of blanks, runs of empty lines, then an empty line around headings and fences."""
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = sub(sub(x, "[ \t]+", " "), "\n\n\n\n+", "\n\n\n")
    x = sub(sub(x, f"([^\n])\n(######{WS}|#####{WS}|####{WS}|###{WS}|##{WS}|#{WS})", "$1\n\n$2"), "(#[^\n]*)\n([^\n#])", "$1\n\n$2")
    return sub(sub(x, "([^\n])\n```", "$1\n\n```"), "```\n([^\n])", "```\n\n$1")


def words(x):
    """Word count the long way: blank punctuation, split, drop empties."""
    split = f"string_split_regex({sub(x, '[^a-zA-Z0-9_' + core.WS_SET + ']', ' ')}, {q(WS + '+')})"
    return f"len(list_filter({split}, lambda w: w <> ''))"


def sentences(x):
    return f"len(list_filter(string_split_regex({x}, '[.!?]+'), lambda s: {has('s', NON_WS)}))"


def _lines(x, condition):
    """How many lines of a text meet a condition on ``l``."""
    return f"len(list_filter(str_split({x}, chr(10)), lambda l: {condition}))"


def struct_counts(x):
    """Counts line by line, where the functions search the whole text."""
    bare = f"ltrim(l, ' ' || chr(9) || chr(13) || chr(160))"
    counts = {f"h{n}": _lines(x, f"starts_with(l, '{'#' * n} ')") for n in range(1, 7)}
    counts["headings"] = "(" + " + ".join(counts.values()) + ")"
    return counts | {
        "unordered": _lines(x, " OR ".join(f"starts_with({bare}, '{c} ')" for c in "-*+")),
        "ordered": _lines(x, f"regexp_matches({bare}, '^[0-9]+[.] ')"),
        "fences": f"((length({x}) - length(replace({x}, '```', ''))) // 3)",
        "inline_code": cnt(x, "`[^`]+`"),
        "links": cnt(x, r"\[[^\]]*\]\([^)]*\)"),
        "images": cnt(x, r"!\[[^\]]*\]\([^)]*\)"),
        "tables": _lines(x, "length(l) - length(replace(l, '|', '')) >= 2"),
        "blockquotes": _lines(x, "starts_with(l, '>')"),
    }


def content_type(x):
    n = struct_counts(x)
    return (
        f"CASE WHEN {n['fences']} / 2.0 > 3 OR {n['inline_code']} > 10 THEN 'technical-documentation' "
        f"WHEN {n['headings']} > 3 THEN 'structured-document' "
        f"WHEN {n['unordered']} + {n['ordered']} > 5 THEN 'list-heavy' WHEN {n['tables']} > 2 THEN 'data-heavy' "
        f"ELSE 'general-text' END"
    )


def hash36(x):
    """Hash as base 36 digits; test tables hold no characters beyond the basic plane."""
    h = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(str_split({x}, ''), "
        f"lambda c: CASE WHEN c = '' THEN 0 ELSE unicode(c) END::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
    )
    signed = f"abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)"
    digits = "'0123456789abcdefghijklmnopqrstuvwxyz'"
    place = f"list_transform(range(0, 7), lambda k: substr({digits}, ((v // (36 ** k)::BIGINT) % 36)::INTEGER + 1, 1))"
    raw = f"list_transform([{signed}], lambda v: reverse(array_to_string({place}, '')))[1]"
    trimmed = f"ltrim({raw}, '0')"
    return f"CASE WHEN {trimmed} = '' THEN '0' ELSE {trimmed} END"
