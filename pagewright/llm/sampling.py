"""Bounded samples of tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 40


def drawn(rows: DataFrame, k: int, salt: str, of: int) -> DataFrame:
    """At most ``k`` of ``rows``, those of the least hashes of the whole row; ``of`` is about how many there are.

    Hashes above a share that leaves about four times ``k`` rows are dropped where the rows are read, so what moves
    is bounded however many partitions there are. Where that leaves too few, because ``of`` is far too large or very
    many rows are equal, each partition gives up to ``k`` rows instead. A table with ``k`` rows or fewer is drawn whole.
    """
    place = F.pmod(F.xxhash64(F.lit(salt), *rows.columns), F.lit(_PARTS))
    share = min(_PARTS, _PARTS * (4 * k + 1000) // max(of, 1))
    if share < _PARTS:
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(place < share).alias("few")).first()
        if found.few >= min(k, found.n):
            rows = rows.where(place < share)
    return rows.orderBy(place).limit(k)
