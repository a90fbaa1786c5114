"""Small building blocks shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web browsers and JavaScript define it. Java's and RE2's \s are
# narrower, so every pattern spells the class out and means the same everywhere.
WS_SET = (
    r"\t\n\x0B\x0C\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
# Most characters are neither: a coarse range in front of the set settles them with
# two comparisons. Java reads && as intersection and a nested class as union.
WS = rf"[\x00-\x20\x{{A0}}-\x{{FEFF}}&&[{WS_SET}]]"
NON_WS = rf"[\x21-\x{{9F}}[^{WS_SET}]]"
EDGE_WS = f"^{WS}+|{WS}+$"
#: Any character but a line end.
NOT_EOL = r"[^\n\r\x{2028}\x{2029}]"

#: The same white space set as characters, for Python's ``str.strip``.
WS_CHARS = (
    "\t\n\x0b\x0c\r \xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　﻿"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once: Spark shares no parts of a lambda, and few of a condition's branches."""
    return F.transform(F.array(value), use)[0]


def count_matches(c: Column | str, pattern: str) -> Column:
    found = F.regexp_count(col(c), F.lit(FASTER.get(pattern, pattern))).cast("long")
    if (needed := NEEDED.get(pattern)) is None:
        return found
    return F.when(~_has(col(c), needed), F.lit(0).cast("long")).otherwise(found)


#: What a text must contain, or any of what it must contain, for the pattern to match; looking for it is far cheaper.
NEEDED: dict[str, str | tuple[str, ...]] = {
    r"\r\n": "\r\n", r"\r": "\r", r"\n{4,}": "\n\n\n\n", r"\n{3,}": "\n\n\n",
    rf"([^\n])\n(#{{1,6}}{WS})": "\n#", r"(#{1,6}[^\n]*)\n([^\n#])": "#",
    r"([^\n])\n```": "\n```", r"```\n([^\n])": "```\n",
    r"(?s)```.*?```": "```", r"`[^`]+`": "`", r"\[([^\]]+)\]\([^)]+\)": "](", r"!\[[^\]]*\]\([^)]+\)": "](",
    rf"(?m)^#{{1,6}}{WS}+": "#", rf"(?m)^>{WS}*": ">", " {2,}": "  ",
    r"[*_]{1,2}([^*_]+)[*_]{1,2}": ("*", "_"),
    rf"(?m)^({WS}*[-*+]){WS}+$": ("-", "*", "+"), rf"(?m)^{WS}*[-*+]{WS}+": ("-", "*", "+"),
    **{rf"(?m)^{'#' * n} ": "# " for n in range(1, 7)}, r"(?m)^#{1,6} ": "# ", rf"(?m)^#{{1,6}}{WS}": "#",
    rf"(?m)^{WS}*[-*+] ": ("- ", "* ", "+ "), rf"(?m)^{WS}*[-*+]{WS}": ("-", "*", "+"), rf"(?m)^{WS}*[0-9]+\. ": ". ",
    "```": "```", r"\[[^\]]*\]\([^)]*\)": "](", r"!\[[^\]]*\]\([^)]*\)": "](", rf"\|{NOT_EOL}*\|": "|", r"(?m)^>": ">",
}

#: Patterns that find the same without trying parts of a word or of a line in vain.
FASTER = {r"(#{1,6}[^\n]*)\n([^\n#])": r"(#[^\n]*+)\n([^\n#])", r"[a-zA-Z0-9_]+": r"\w++"}

_WS_BUT_SPACE = WS.replace(r"\x20", r"\x1F")
#: Steps that mostly put what is there already: a pattern of what they change, and what a text must contain for that.
CHANGES = {
    (rf"{WS}+", " "): (rf" {WS}+|{_WS_BUT_SPACE}{WS}*", ()),
    (r"[ \t]+", " "): (r" [ \t]+|\t[ \t]*", ("  ", "\t")),
    (r"[ \t\r\n]+", " "): (r" [ \t\r\n]+|[\t\r\n][ \t\r\n]*", ()),
    (r" *\n *", "\n"): (r" +\n *|\n +", (" \n", "\n ")),
}


def replace_all(c: Column | str, steps: Iterable[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) steps in order; replacements use ``$1``."""
    out = col(c)
    for pattern, replacement in steps:
        out = _replaced(out, pattern, replacement)
    return out


def _has(text: Column, needed: str | tuple[str, ...]) -> Column:
    first, *others = (needed,) if isinstance(needed, str) else needed
    found = text.contains(first)
    for other in others:
        found = found | text.contains(other)
    return found


def _replaced(text: Column, pattern: str, replacement: str) -> Column:
    if (pattern, replacement) in EDGES:
        return let(text, EDGES[pattern, replacement])
    pattern, needed = CHANGES.get((pattern, replacement), (FASTER.get(pattern, pattern), NEEDED.get(pattern, ())))
    if not needed:
        return F.regexp_replace(text, pattern, replacement)
    return let(text, lambda t: F.when(_has(t, needed), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def squeezed(text: Column | str) -> Column:
    """Runs of white space as one space each."""
    return _replaced(col(text), rf"{WS}+", " ")


def _ends(t: Column, *ends: str) -> Column:
    found = t.endswith(ends[0])
    for e in ends[1:]:
        found = found | t.endswith(e)
    return found


#: The last line end of a text, before which $ may stand.
LINE_ENDS = ("\r\n", "\r", "\x85", "\u2028", "\u2029")


def _without_edge_spaces(t: Column) -> Column:
    start = (
        F.when(t.startswith("  "), F.substring(t, F.lit(2), F.length(t)))
        .when(t.startswith(" "), F.ltrim(t)).otherwise(t)
    )

    def end(s: Column) -> Column:
        return (
            F.when(s.endswith("  "), F.substring(s, F.lit(1), F.length(s) - 1))
            .when(s.endswith(" "), F.rtrim(s))
            .when(_ends(s, " \n", *(f" {e}" for e in LINE_ENDS)), F.regexp_replace(s, " $", "")).otherwise(s)
        )

    return let(start, end)


def _one_last_newline(t: Column) -> Column:
    # one newline becomes one newline
    several = _ends(t, "\n\n", *(f"\n\n{e}" for e in LINE_ENDS))
    return F.when(several, F.regexp_replace(t, r"\n+$", "\n")).otherwise(t)


def _without_last_space(t: Column) -> Column:
    # The last three line ends are not among the characters; before one of them a run goes, too.
    cut = F.when(_ends(t, *LINE_ENDS[2:]), F.regexp_replace(t, r"[\t\r\n ]+$", ""))
    return cut.when(_ends(t, "\t", "\r", "\n", " "), F.rtrim(t, F.lit("\t\r\n "))).otherwise(t)


#: Steps on the ends of a text, which need not look at what is between.
EDGES = {
    (r"^ | $", ""): _without_edge_spaces,
    (r"\n+$", "\n"): _one_last_newline,
    (r"[\t\r\n ]+$", ""): _without_last_space,
}


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(col(c), EDGE_WS, "")


def is_blank(c: Column | str) -> Column:
    """True for NULL, empty and all-white-space text."""
    return F.coalesce(~col(c).rlike(NON_WS), F.lit(True))


def blank_to_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), col(c))


def round_half_up(c: Column, places: int = 0) -> Column:
    """``floor(x * 10^p + 0.5) / 10^p`` on the double, not decimal rounding."""
    if places == 0:
        return F.floor(c + F.lit(0.5)).cast("long")
    scale = float(10**places)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def warnings_of(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs])
    )


def lookup_map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
