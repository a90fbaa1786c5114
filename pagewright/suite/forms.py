"""Markdown of the forms that stored pages rarely hold: lists, tables, code, links, images, quotes.

The html is made of the lines of every document, as letters and spaces, so that both engines can say what
must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markdown as MD
from ..operators.content import by_page
from ..sources.tables import read_table
from .registry import query

#: Lines of words of ASCII letters, those without any left out.
_LINES = """(SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda x: trim(regexp_replace(x, '[^a-zA-Z]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents)"""


def _lines(spark, d):
    # Laid out by their key while they are short; all that is made of them stays there.
    docs = by_page(read_table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))
    letters = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[^a-zA-Z]+", " ")))
    return docs.select("page_id", F.filter(letters, lambda x: x != "").alias("ls"))


def _all(each, between=""):
    return F.array_join(F.transform("ls", each), between)


def _rendered(spark, d, html):
    rows = _lines(spark, d).select("page_id", html.alias("content_html"))
    return MD.render_markdown(rows).select(F.col("page_id").alias("doc_id"), F.md5("markdown").alias("digest"))


def _twin(markdown):
    """SQL for the digests of ``markdown``, an expression over the lines ``ls``; nothing comes of no lines."""
    return f"SELECT doc_id, md5(CASE WHEN len(ls) = 0 THEN '' ELSE {markdown} END) AS digest FROM {_LINES}"


def _joined(each, between="chr(10)", lines="ls"):
    return f"list_reduce(list_transform({lines}, {each}), lambda a, b: a || {between} || b)"


@query("markdown_bullet_list", _twin(_joined("lambda x: '- ' || x")))
def markdown_bullet_list(spark, d):
    """Items of a list, one line each."""
    return _rendered(spark, d, F.concat(F.lit("<ul>"), _all(lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), F.lit("</ul>")))


@query("markdown_numbered_list", _twin(_joined("lambda x, i: i || '. ' || x")))
def markdown_numbered_list(spark, d):
    """Items are numbered in order."""
    return _rendered(spark, d, F.concat(F.lit("<ol>"), _all(lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), F.lit("</ol>")))


_ROW = "'| ' || string_split(x, ' ')[1] || ' | ' || x || ' |'"


@query(
    "markdown_table",
    _twin(f"'| first | line |' || chr(10) || '| --- | --- |' || chr(10) || {_joined(f'lambda x: {_ROW}')}"),
)
def markdown_table(spark, d):
    """A table with a head, one row for each line."""
    row = lambda x: F.concat(F.lit("<tr><td>"), F.substring_index(x, " ", 1), F.lit("</td><td>"), x, F.lit("</td></tr>"))
    head = "<table><thead><tr><th>first</th><th>line</th></tr></thead><tbody>"
    empty = F.size("ls") == 0
    return _rendered(spark, d, F.when(empty, "").otherwise(F.concat(F.lit(head), _all(row), F.lit("</tbody></table>"))))


_CODE = _joined("lambda x: x")
_LANGUAGE = f"""CASE WHEN contains({_CODE}, 'function ') OR contains({_CODE}, 'const ') THEN 'javascript'
    WHEN contains({_CODE}, 'def ') OR contains({_CODE}, 'import ') THEN 'python' ELSE '' END"""


@query(
    "markdown_code_block",
    # Fences stand apart from what is around them, but for what follows a language.
    _twin(
        f"""'```' || {_LANGUAGE} || chr(10) || CASE WHEN {_LANGUAGE} = '' THEN chr(10) ELSE '' END || {_CODE} || chr(10) || chr(10) || '```'
        || chr(10) || chr(10) || 'use `' || string_split(ls[1], ' ')[1] || '` here'"""
    ),
)
def markdown_code_block(spark, d):
    """A fenced block that keeps its lines, then a word as inline code."""
    code = F.concat(F.lit("<pre><code>"), _all(lambda x: x, "\n"), F.lit("</code></pre>"))
    inline = F.concat(F.lit("<p>use <code>"), F.substring_index(F.get("ls", 0), " ", 1), F.lit("</code> here</p>"))
    return _rendered(spark, d, F.when(F.size("ls") == 0, "").otherwise(F.concat(code, inline)))


@query(
    "markdown_links_images",
    _twin(
        _joined(
            """lambda x, i: '[' || x || '](https://cdn.example.com/' || i || ' "t' || i || '") ![' || x || '](/img/' || i || '.png)'""",
            "chr(10) || chr(10)",
        )
    ),
)
def markdown_links_images(spark, d):
    """A link with a title and an image for each line; links without a scheme get one, and those without an address are text."""
    def line(x, i):
        n = (i + 1).cast("string")
        link = F.concat(F.lit('<a href="//cdn.example.com/'), n, F.lit('" title="t'), n, F.lit('">'), x, F.lit("</a>"))
        return F.concat(F.lit("<p>"), link, F.lit(' <img src="/img/'), n, F.lit('.png" alt="'), x, F.lit('"><img alt="none"></p>'))

    return _rendered(spark, d, _all(line))


@query("markdown_quotes", _twin(_joined("lambda x: '> ' || x", "chr(10) || chr(10)")))
def markdown_quotes(spark, d):
    """A block quote for each line."""
    return _rendered(spark, d, _all(lambda x: F.concat(F.lit("<blockquote>"), x, F.lit("</blockquote>"))))
