"""Column functions over Markdown text: clean-up, plain text, statistics, code languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import NOT_EOL, WS, WS_SET, col, count_matches, replace_all, trim_ws, warnings_of

# Blank lines before a fence or heading and after it.
SPACE_FENCES = ((r"([^\n])\n```", "$1\n\n```"), (r"```\n([^\n])", "```\n\n$1"))
SPACE_HEADINGS = (
    (rf"([^\n])\n(#{{1,6}}{WS})", "$1\n\n$2"),
    (r"(#{1,6}[^\n]*)\n([^\n#])", "$1\n\n$2"),
)

# Patterns and replacements, in order.
PRE_STEPS = (
    (rf"(?i)<p[^>]*>{WS}*</p>", ""),
    (r"(?i)<p[^>]*>([^<]*)<p[^>]*>", "<p>$1</p><p>"),
    # A lazy body and trailing white space outside the group trims the code.
    (
        rf"(?is)<pre[^>]*>{WS}*<code[^>]*>{WS}*(.*?){WS}*</code>{WS}*</pre>",
        "<pre><code>$1</code></pre>",
    ),
    (rf"{WS}{{3,}}", " "),
    (rf"(?i)</li>{WS}*<li>", "</li>\n<li>"),
)
PRE_STEPS_KEEP_CODE = PRE_STEPS[:3] + PRE_STEPS[4:]

# Patterns and replacements, in order.
POST_STEPS = (
    (r"\n{4,}", "\n\n\n"),
    (r"^\n+", ""),
    (r"\n+$", "\n"),
    (rf"(?m)^({WS}*[-*+]){WS}+$", "$1 "),
    (rf"(?m)^({WS}*[0-9]+\.){WS}+$", "$1 "),
    *SPACE_FENCES,
    *SPACE_HEADINGS,
)

# Patterns and replacements, in order.
TEXT_STEPS = (
    (r"(?s)```.*?```", " "),
    (r"`[^`]+`", " "),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (rf"(?m)^#{{1,6}}{WS}+", ""),
    (rf"(?m)^{WS}*[-*+]{WS}+", ""),
    (rf"(?m)^{WS}*[0-9]+\.{WS}+", ""),
    (rf"(?m)^>{WS}*", ""),
    (r"[*_]{1,2}([^*_]+)[*_]{1,2}", "$1"),
    (rf"{WS}+", " "),
    (r"^ | $", ""),
)

FENCE = "```"
HEADING = rf"(?m)^#{{1,6}}{WS}"
LINK = r"\[[^\]]*\]\([^)]*\)"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LIST_ITEM = rf"(?m)^{WS}*[-*+]{WS}"
TABLE_ROW = rf"\|{NOT_EOL}*\|"

# Class name forms that carry a language, in order.
LANGUAGE_CLASSES = (
    r"language-(\w+)", r"lang-(\w+)", r"highlight-(\w+)", r"(\w+)-code", r"^(\w+)$",
)


def preprocess_html(html: Column | str, preserve_code: bool = False) -> Column:
    return replace_all(html, PRE_STEPS_KEEP_CODE if preserve_code else PRE_STEPS)


def postprocess(markdown: Column | str) -> Column:
    return replace_all(markdown, POST_STEPS)


def to_plain_text(markdown: Column | str) -> Column:
    return replace_all(markdown, TEXT_STEPS)


def code_language(class_name: Column | str, code: Column | str) -> Column:
    """Language from the class attribute, else from hints in the code, else ''."""
    cls, body = F.coalesce(col(class_name), F.lit("")), F.coalesce(col(code), F.lit(""))
    from_class = F.coalesce(
        *[F.when(cls.rlike(rx), F.lower(F.regexp_extract(cls, rx, 1))) for rx in LANGUAGE_CLASSES]
    )
    from_code = (
        F.when(body.contains("function ") | body.contains("const ") | body.contains("=>"), "javascript")
        .when(body.contains("def ") | body.contains("import "), "python")
        .when(body.contains("<?php"), "php")
        .otherwise("")
    )
    return F.coalesce(from_class, from_code)


def conversion_stats(html: Column, markdown: Column, text: Column) -> Column:
    md_len, html_len = F.length(markdown).cast("long"), F.length(html).cast("long")
    return F.struct(
        html_len.alias("html_length"),
        md_len.alias("markdown_length"),
        F.length(text).cast("long").alias("text_length"),
        F.try_divide(md_len.cast("double"), html_len.cast("double")).alias("compression_ratio"),
        (count_matches(markdown, FENCE) / 2.0).alias("code_blocks"),
        count_matches(markdown, HEADING).alias("headings"),
        count_matches(markdown, LINK).alias("links"),
        count_matches(markdown, IMAGE).alias("images"),
        count_matches(markdown, LIST_ITEM).alias("lists"),
        count_matches(markdown, TABLE_ROW).alias("tables"),
    )


# The messages.
def conversion_warnings(prepared_html: Column, raw_markdown: Column, markdown: Column) -> Column:
    return warnings_of(
        (
            prepared_html.contains("<table") & ~prepared_html.contains("<th"),
            "Table found without header cells - may not convert properly",
        ),
        (
            count_matches(prepared_html, r"(?i)<code[^>]*>") > 10,
            "Many code blocks detected - verify formatting in output",
        ),
        (
            F.length(markdown) < F.length(raw_markdown) * 0.5,
            "Significant content loss during post-processing",
        ),
    )


__all__ = [
    "preprocess_html", "postprocess", "to_plain_text", "code_language", "conversion_stats",
    "conversion_warnings", "trim_ws", "WS_SET",
]
