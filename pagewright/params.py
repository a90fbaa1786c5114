"""Arguments of the page job with their ranges, checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


class ParameterError(ValueError):
    """An argument outside its range; ``field`` names it."""

    def __init__(self, message: str, field: str):
        super().__init__(message)
        self.field = field


def _int_in(name: str, value, low: int, high: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ParameterError(f"{name} must be an integer", name)
    if not low <= value <= high:
        raise ParameterError(f"{name} must be between {low} and {high}", name)


@dataclass(frozen=True)
class PageJobParams:
    crawl_depth: int = 2
    include_globs: tuple[str, ...] = ()
    chunk_size: int = 1000
    chunk_overlap: int = 100
    #: Pages of a run; None for all that are reached.
    max_pages: int | None = 1000
    separators: tuple[str, ...] = ("\n\n", "\n", " ", "")
    char_threshold: int = 500
    min_content_length: int = 100
    max_content_length: int = 1_000_000
    max_html_length: int = 50 * 1024 * 1024
    max_metadata_size: int = 10_000
    enable_fallback: bool = True
    model: str = "gpt-3.5-turbo"
    price_overrides: dict = field(default_factory=dict)

    def __post_init__(self):
        _int_in("crawl_depth", self.crawl_depth, 1, 10)
        _int_in("chunk_size", self.chunk_size, 100, 8000)
        _int_in("chunk_overlap", self.chunk_overlap, 0, 500)
        if self.max_pages is not None:
            _int_in("max_pages", self.max_pages, 1, 10_000)
        if self.chunk_overlap >= self.chunk_size:
            raise ParameterError("chunk_overlap must be less than chunk_size", "chunk_overlap")
        if not self.separators:
            raise ParameterError("separators must not be empty", "separators")
        for pattern in self.include_globs:
            check_glob(pattern)


def check_glob(pattern: str) -> None:
    """A glob must be non-blank and hold ``://`` or start with ``*``."""
    if not isinstance(pattern, str) or not pattern.strip():
        raise ParameterError("glob must be a non-empty string", "include_globs")
    if "://" not in pattern and not pattern.startswith("*"):
        raise ParameterError(f"not a URL pattern: {pattern}", "include_globs")
