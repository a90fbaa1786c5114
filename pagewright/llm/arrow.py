"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewright.llm.ids import release


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def portions(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_portions(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about ``size`` bytes, or one row with a longer text."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = upto[first - 1] if first else 0
            end = max(int(np.searchsorted(upto, before + size, "right")), first + 1)
            yield batch.slice(first, end - first)
            first = end


def add_columns(df, text: str, added: str, make) -> "DataFrame":  # noqa: F821
    """``df`` with columns computed from one text column, batch by batch.

    ``make`` takes a list of byte texts and returns the arrays of the columns that ``added`` names (a
    schema string). The columns of ``df`` pass through under numbered names, so none can clash;
    the result has them first, as ``_0``, ``_1`` and so on.
    """
    from pyspark.sql.types import StructType

    names = [f"_{i}" for i in range(len(df.columns))]
    at = df.columns.index(text)
    shape = StructType.fromDDL(added)

    def run(batches):
        release()
        for b in portions(batches, 500):
            yield pa.RecordBatch.from_arrays([*b.columns, *make(byte_texts(b.column(at)))], [*names, *shape.names])

    renamed = df.toDF(*names)
    return renamed.mapInArrow(run, StructType(renamed.schema.fields + shape.fields))
