"""The splitter as a table function of SQL, with the clean-up and the counts it goes with.

After :func:`register`, in any query of the session::

    SELECT * FROM split_text(TABLE(SELECT doc_id, clean_text(body) AS body FROM docs), 'body', 1000, 100)
    SELECT * FROM split_text(TABLE(docs), 'body', chunk_size => 200, chunk_overlap => 20, length => 'tokens')

The result has the columns of the table but the text, then those of a chunk. Its schema follows from the
arguments when the query is analysed, so wrong columns, sizes and names fail before any task
runs. Rows are split where they are: the table is neither shuffled nor sorted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .core import WS_CHARS
from .lengths import length_function
from .splitting import split_text
from .text import CLEAN_STEPS

SEPARATORS = ("\n\n", "\n", " ", "")
#: What a chunk adds to the columns of its row.
CHUNK_FIELDS = T.StructType().add("chunk_index", T.IntegerType()).add("total_chunks", T.IntegerType()).add(
    "content", T.StringType()
).add("length", T.IntegerType()).add("start_offset", T.IntegerType()).add("end_offset", T.IntegerType())


def _constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class SplitText:
    """One row for each chunk; blank and null texts give none."""

    @staticmethod
    def analyze(
        rows: AnalyzeArgument,
        text: AnalyzeArgument,
        chunk_size: AnalyzeArgument | None = None,
        chunk_overlap: AnalyzeArgument | None = None,
        separators: AnalyzeArgument | None = None,
        length: AnalyzeArgument | None = None,
        keep_separator: AnalyzeArgument | None = None,
    ) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table: TABLE(name) or TABLE(SELECT ...)")
        column = _constant(text, "text")
        fields = {f.name: f for f in rows.dataType.fields}
        if column not in fields:
            raise ValueError(f"the table has no column {column!r}: it has {', '.join(fields)}")
        if not isinstance(fields[column].dataType, T.StringType):
            raise ValueError(f"column {column!r} is not a string")
        taken = [f.name for f in CHUNK_FIELDS if f.name in fields and f.name != column]
        if taken:
            raise ValueError(f"rename the columns {', '.join(taken)}, which chunks have too")
        size = 1000 if chunk_size is None else _constant(chunk_size, "chunk_size")
        overlap = 100 if chunk_overlap is None else _constant(chunk_overlap, "chunk_overlap")
        if not isinstance(size, int) or not isinstance(overlap, int) or not 0 <= overlap < size:
            raise ValueError("need whole numbers 0 <= chunk_overlap < chunk_size")
        if separators is not None and not _constant(separators, "separators"):
            raise ValueError("separators must not be empty")
        if length is not None:
            length_function(_constant(length, "length"))
        kept = [f for name, f in fields.items() if name != column]
        return AnalyzeResult(schema=T.StructType([*kept, *CHUNK_FIELDS]))

    def eval(
        self,
        rows: Row,
        text: str,
        chunk_size: int = 1000,
        chunk_overlap: int = 100,
        separators: Sequence[str] = SEPARATORS,
        length: str = "chars",
        keep_separator: bool = False,
    ) -> Iterator[tuple]:
        values = rows.asDict()
        body = values.pop(text)
        if not body or not body.strip(WS_CHARS):
            return
        kept = tuple(values.values())
        chunks = list(split_text(body, chunk_size, chunk_overlap, tuple(separators), keep_separator, length_function(length)))
        for i, (content, start, end) in enumerate(chunks):
            yield (*kept, i, len(chunks), content, len(content), start, end)


def _literal(text: str) -> str:
    """A SQL string in the escapes that Spark's parser knows."""
    return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 or c in "\\'" else c for c in text) + "'"


def clean_expression(column: str) -> str:
    """The clean-up of text before it is split, as SQL."""
    out = column
    for pattern, replacement in CLEAN_STEPS:
        out = f"regexp_replace({out}, {_literal(pattern)}, {_literal(replacement)})"
    return out


def register(spark: SparkSession) -> None:
    """Make ``split_text`` (table function) and ``clean_text`` (function) known to the SQL of a session."""
    spark.udtf.register("split_text", udtf(SplitText))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_text(body STRING) RETURNS STRING RETURN {clean_expression('body')}")
