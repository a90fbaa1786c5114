"""Queries over the splitter with overlap, as a column step and as a table function of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..operators import chunking as C
from . import duck as D
from .registry import query
from .scalars import MD_DOCS, markdown_docs


def split_twin(size: int, overlap: int, measure: str = "length") -> str:
    """DuckDB SQL of the split rules for the separators line feed and space, pack by pack.

    Pieces are the lines of a text, or the words of a line that is too long (or of a text without line
    feeds). Runs of pieces with one separator are packed: a pack takes pieces while their sizes and the separators
    between them fit, and the next one starts as far back as the overlap and the piece to come allow.
    """
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {D.clean('markdown')} AS t FROM {MD_DOCS} WHERE {D.has('markdown', D.NON_WS)}),
lines AS (SELECT doc_id, i, ls[i] AS piece, contains(t, chr(10)) AND {measure}(ls[i]) < {size} AS fits
  FROM (SELECT doc_id, t, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM d)) WHERE ls[i] <> ''),
pieces AS (SELECT doc_id, i, 0 AS j, piece, chr(10) AS sep, false AS alone FROM lines WHERE fits
  UNION ALL SELECT doc_id, i, j, ws[j], ' ', {measure}(ws[j]) >= {size}
  FROM (SELECT doc_id, i, ws, unnest(range(1, len(ws) + 1)) AS j FROM (SELECT doc_id, i, string_split(piece, ' ') AS ws FROM lines WHERE NOT fits))
  WHERE ws[j] <> ''),
marked AS (SELECT *, CASE WHEN alone OR lag(alone) OVER o OR sep <> lag(sep) OVER o OR (sep = ' ' AND i <> lag(i) OVER o) THEN 1 ELSE 0 END AS starts
  FROM pieces WINDOW o AS (PARTITION BY doc_id ORDER BY i, j)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i, j) AS run FROM marked),
summed AS (SELECT *, sum({measure}(piece)) OVER (PARTITION BY doc_id, run ORDER BY i, j) AS upto FROM numbered),
runs AS (SELECT doc_id, run, any_value(sep) AS sep, bool_or(alone) AS alone, list(piece ORDER BY i, j) AS ps,
  list_prepend(0, list(upto ORDER BY i, j)) AS b, count(*) AS n FROM summed GROUP BY doc_id, run),
packs AS (
  SELECT doc_id, run, 0::BIGINT AS a, coalesce(list_min(list_filter(range(1, n), lambda k: b[k + 2] + k > {size})), n)::BIGINT AS z FROM runs
  UNION ALL
  SELECT doc_id, run, k, coalesce(list_min(list_filter(range(z + 1, n), lambda x: b[x + 2] - b[k + 1] + (x - k) > {size})), n)
  FROM (SELECT p.doc_id, p.run, p.z, r.n, r.b, list_min(list_filter(range(p.a, p.z + 1), lambda s: r.b[p.z + 1] - r.b[s + 1] <= {overlap}
          AND (r.b[p.z + 1] = r.b[s + 1] OR r.b[p.z + 2] - r.b[s + 1] + (p.z - s) <= {size}))) AS k
        FROM packs p JOIN runs r ON r.doc_id = p.doc_id AND r.run = p.run WHERE p.z < r.n)),
joined AS (SELECT p.doc_id, p.run, p.a, r.alone, CASE WHEN r.sep = ' ' THEN array_to_string(r.ps[p.a + 1:p.z], ' ')
  ELSE array_to_string(r.ps[p.a + 1:p.z], chr(10)) END AS body FROM packs p JOIN runs r ON r.doc_id = p.doc_id AND r.run = p.run),
texts AS (SELECT doc_id, run, a, CASE WHEN alone THEN body ELSE {D.trim_ws('body')} END AS content FROM joined)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, a) - 1 AS chunk_index,
  count(*) OVER (PARTITION BY doc_id) AS total_chunks, content FROM texts WHERE content <> ''
"""


def _shown(chunks):
    return chunks.select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "content"
    )


@query("chunk_split_overlap", split_twin(300, 60))
def chunk_split_overlap(spark, d):
    """Chunks with overlap, each equal to those of the rules."""
    docs = markdown_docs(spark, d).select("doc_id", "markdown")
    return _shown(C.chunk_documents(docs, "markdown", 300, 60, separators=("\n", " ")))


@query("chunk_split_by_bytes", split_twin(200, 40, "strlen"))
def chunk_split_by_bytes(spark, d):
    """Chunk sizes by a named length function."""
    docs = markdown_docs(spark, d).select("doc_id", "markdown")
    return _shown(C.chunk_documents(docs, "markdown", 200, 40, separators=("\n", " "), length="utf8_bytes"))


@query("sql_split_text", split_twin(250, 100))
def sql_split_text(spark, d):
    """The table function in SQL."""
    table_functions.register(spark)
    docs = markdown_docs(spark, d).select("doc_id", "markdown")
    return spark.sql(
        """SELECT doc_id, chunk_index::BIGINT AS chunk_index, total_chunks::BIGINT AS total_chunks, content
           FROM split_text(TABLE(SELECT doc_id, clean_text(markdown) AS body FROM {docs}), 'body', 250, 100, separators => array('\\n', ' '))""",
        docs=docs,
    )


@query("sql_split_text_by_bytes", split_twin(150, 50, "strlen"))
def sql_split_text_by_bytes(spark, d):
    """The table function with a named length function."""
    table_functions.register(spark)
    docs = markdown_docs(spark, d).select("doc_id", "markdown")
    return spark.sql(
        """SELECT doc_id, chunk_index::BIGINT AS chunk_index, total_chunks::BIGINT AS total_chunks, content
           FROM split_text(TABLE(SELECT doc_id, clean_text(markdown) AS body FROM {docs}), 'body', chunk_size => 150, chunk_overlap => 50,
                           separators => array('\\n', ' '), length => 'utf8_bytes')""",
        docs=docs,
    )
