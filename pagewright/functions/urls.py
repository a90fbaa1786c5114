"""URL predicates, parts, normal form, globs and the admission decision."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

# Groups: 1 scheme, 2 user part, 3 host, 4 port, 5 path, 6 query, 7 fragment.
URL_PATTERN = (
    r"(?i)^(https?)://([^/?#@\s]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\s\[\]]+)(?::([0-9]*))?"
    r"(/[^?#]*)?(\?[^#]*)?(#.*)?$"
)
#: Characters of a path or query that a normalised URL carries percent-encoded.
UNSAFE_CHAR = r"[^\x21-\x7E]|[\"<>`{}]"
DOT_SEGMENT = r"(^|/)\.\.?(/|$)"

# Query parameters dropped for deduplication, file types not fetched.
DROPPED_PARAMS = ("utm_*", "ref", "source")
EXCLUDED_GLOBS = (
    "**/*.pdf", "**/*.doc", "**/*.docx", "**/*.xls", "**/*.xlsx", "**/*.ppt",
    "**/*.pptx", "**/*.zip", "**/*.tar.gz", "**/*.exe", "**/*.dmg",
)


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(col(url), URL_PATTERN, group)


def is_http_url(url: Column | str) -> Column:
    return F.coalesce(col(url).rlike(URL_PATTERN), F.lit(False))


def scheme(url: Column | str) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column | str) -> Column:
    """Lower-case host, '' where the URL does not parse."""
    return F.coalesce(F.lower(_part(url, 3)), F.lit(""))


def path(url: Column | str) -> Column:
    p = _part(url, 5)
    return F.when(is_http_url(url), F.when(p == "", "/").otherwise(p)).otherwise("")


def port_suffix(url: Column | str) -> Column:
    """``:port`` unless it is missing or the default of the scheme."""
    p = _part(url, 4)
    default = F.when(scheme(url) == "https", "443").otherwise("80")
    return F.when((p == "") | (p == default), "").otherwise(F.concat(F.lit(":"), p))


def origin(url: Column | str) -> Column:
    """``scheme://host[:port]``, NULL where the URL does not parse."""
    return F.when(
        is_http_url(url), F.concat(scheme(url), F.lit("://"), host(url), port_suffix(url))
    )


def encode_unsafe(c: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(c, ""),
            lambda ch: F.when(
                ch.rlike(UNSAFE_CHAR), F.regexp_replace(F.hex(ch), "(..)", "%$1")
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(UNSAFE_CHAR), encoded).otherwise(c)


def resolve_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.substr(p, F.lit(2)), "/")

    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    tail = F.when(p.rlike(r"/\.\.?$"), "/").otherwise("")
    joined = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//$", "/")
    return F.when(p.rlike(DOT_SEGMENT), joined).otherwise(p)


def normalize(url: Column | str) -> Column:
    """No fragment, lower-case host, no default port, ``/`` for an empty path.

    Text that is not an http(s) URL is returned as it is.
    """
    u = F.concat(
        scheme(url), F.lit("://"), _part(url, 2), host(url), port_suffix(url),
        encode_unsafe(resolve_dots(path(url))),
        encode_unsafe(F.regexp_replace(_part(url, 6), r"^\?$", "")),
    )
    return F.when(is_http_url(url), u).otherwise(col(url))


def param_pattern(names: Sequence[str]) -> str:
    """``utm_*``-style names as one anchored pattern over ``name[=value]``."""
    parts = [re.escape(n).replace(r"\*", "[^=]*") for n in names]
    return "^(?:" + "|".join(parts) + ")(?:=|$)"


def drop_params(url: Column | str, names: Sequence[str] = DROPPED_PARAMS) -> Column:
    """Remove query parameters by name; the rest keeps its order."""
    rx = param_pattern(names)
    c = col(url)
    base = F.regexp_extract(c, r"^([^?#]*)", 1)
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(c, r"^[^#]*(#.*)?$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rx)), "&")
    return F.concat(
        base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), fragment
    )


def path_depth(url: Column | str) -> Column:
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return F.when(is_http_url(url), F.size(segments)).otherwise(0).cast("long")


def with_https(url: Column | str) -> Column:
    """Protocol-relative ``//host/x`` becomes ``https://host/x``."""
    c = F.coalesce(col(url), F.lit(""))
    return F.when(c.startswith("//"), F.concat(F.lit("https:"), c)).otherwise(c)


def absolute(href: Column | str, base: Column | str) -> Column:
    """Resolve a link against its page; NULL for other schemes (mailto, javascript, ...)."""
    h = F.regexp_replace(col(href), r"^[\s]+|[\s]+$", "")
    b = col(base)
    folder = F.regexp_extract(path(b), r"^(.*/)[^/]*$", 1)
    query = _part(b, 6)
    target = (
        F.when(h.rlike(r"(?i)^https?://"), h)
        .when(h.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), F.lit(None))
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin(b), h))
        .when(h.startswith("?"), F.concat(origin(b), path(b), h))
        .when((h == "") | h.startswith("#"), F.concat(origin(b), path(b), query, h))
        .otherwise(F.concat(origin(b), folder, h))
    )
    return F.when(is_http_url(b), target)


# --- globs -----------------------------------------------------------------

_DOTLESS = r"(?:[^./][^/]*)"


def _braces(glob: str) -> list[str]:
    """Expand ``{a,b}`` alternatives, nested ones too."""
    depth, start, cuts = 0, -1, []
    for i, ch in enumerate(glob):
        if ch == "{":
            if depth == 0:
                start, cuts = i, [i]
            depth += 1
        elif ch == "," and depth == 1:
            cuts.append(i)
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                if len(cuts) == 1:
                    continue
                cuts.append(i)
                options = [glob[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
                return [g for o in options for g in _braces(glob[:start] + o + glob[i + 1 :])]
    return [glob]


def _segment(seg: str) -> str:
    out, i = "", 0
    while i < len(seg):
        ch = seg[i]
        if ch == "*":
            out += "[^/]*"
            while i + 1 < len(seg) and seg[i + 1] == "*":
                i += 1
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in seg[i + 2 :]:
            end = seg.index("]", i + 2)
            body = seg[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif ch == "\\" and i + 1 < len(seg):
            i += 1
            out += re.escape(seg[i])
        else:
            out += re.escape(ch)
        i += 1
    if seg and seg[0] in "*?":
        # A wildcard does not match a segment that starts with a dot; a lone
        # star needs at least one character.
        if set(seg) == {"*"}:
            return r"[^./][^/]*"
        if seg[0] == "?":
            return r"[^./]" + out[len("[^/]") :]
        rest = out[len("[^/]*") :]
        return rf"(?:[^./][^/]*)?{rest}" if not rest.startswith(r"\.") else rf"[^./][^/]*{rest}"
    return out


def glob_to_regex(glob: str) -> str:
    """A path glob as an anchored pattern that Java and RE2 read alike.

    ``*`` and ``?`` stay inside a segment, ``**`` spans segments, ``{a,b}`` and
    ``[...]`` work, runs of ``/`` count as one, and wildcards leave segments
    that start with a dot alone.
    """
    alternatives = []
    for g in _braces(glob):
        segments = re.sub(r"/+", "/", g).split("/")
        out = ""
        for i, seg in enumerate(segments):
            last = i == len(segments) - 1
            if seg == "**":
                out += rf"(?:{_DOTLESS}(?:/+{_DOTLESS})*)?" if last else rf"(?:{_DOTLESS}/+)*"
                continue
            out += _segment(seg)
            if not last:
                out += "/+"
        alternatives.append(out)
    return "^(?:" + "|".join(alternatives) + ")/*$"


def matches_any_glob(url: Column | str, globs: Sequence[str]) -> Column:
    """OR over a driver-side list of globs, kept in one compiled pattern per 200."""
    hit = F.lit(False)
    patterns = [glob_to_regex(g) for g in globs]
    for i in range(0, len(patterns), 200):
        hit = hit | F.coalesce(col(url).rlike("|".join(patterns[i : i + 200])), F.lit(False))
    return hit


def admission(
    url: Column | str,
    depth: Column | str,
    max_depth: int = 3,
    include: Sequence[str] = ("**",),
    exclude: Sequence[str] = (),
) -> Column:
    """Why a URL is or is not followed: depth first, then exclusion, then inclusion."""
    return (
        F.when(col(depth) >= F.lit(max_depth), "depth_exceeded")
        .when(matches_any_glob(url, exclude), "excluded_pattern")
        .when(~matches_any_glob(url, include), "not_included")
        .otherwise("allowed")
    )
