"""Length functions of the splitter by name, so that SQL and stored settings can choose one."""

from __future__ import annotations

from collections.abc import Callable

Length = Callable[[str], int]


def _tokens(text: str) -> int:
    from .tokens import count_tokens_of

    return count_tokens_of(text)


#: What a length may be called. ``chars`` counts code points, ``utf16`` the units that browsers count.
LENGTHS: dict[str, Length] = {
    "chars": len,
    "utf8_bytes": lambda text: len(text.encode()),
    "utf16": lambda text: len(text.encode("utf-16-le")) // 2,
    "words": lambda text: len(text.split()),
    "tokens": _tokens,
}


def length_function(length: str | Length) -> Length:
    """A length function from its name, or the function itself."""
    if callable(length):
        return length
    if length not in LENGTHS:
        raise ValueError(f"unknown length function {length!r}: one of {', '.join(LENGTHS)}")
    return LENGTHS[length]
