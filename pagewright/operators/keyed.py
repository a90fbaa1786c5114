"""Keyed look-ups and running positions that stay balanced when a key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

#: Heaviest keys joined by broadcast. This fixed number of rows is the bound on
#: what is broadcast; any other key holds less than 1/1000 of the rows.
HOT_KEYS = 1000
SALTS = 4096


def attach_by_key(
    df: DataFrame,
    values: DataFrame,
    keys: Sequence[str],
    weight: str,
    columns: Sequence[str],
    spread_by: Sequence[str],
) -> DataFrame:
    """Left join with one row per key, split so that no task gets a whole hot key.

    ``values`` holds ``keys``, ``columns`` and ``weight``, the number of rows a
    key has in ``df`` (or an estimate). The ``HOT_KEYS`` heaviest keys are
    broadcast. Rows they answer get a salt that matches nothing, which spreads
    them over the shuffle of the other keys. The salt is a hash of ``spread_by``,
    columns that tell the rows of a key apart, and not a random number: a task
    that runs again after a lost executor must send each row to the same place.
    """
    keys, columns = list(keys), list(columns)
    hot = (
        values.orderBy(F.col(weight).desc(), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.struct(*columns).alias("_hot"))
    )
    cold = values.select(*keys, F.lit(0).alias("_salt"), F.struct(*columns).alias("_cold"))
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int") + 1
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.lit(0)))
        .join(cold, [*keys, "_salt"], "left")
        .withColumn("_v", F.coalesce("_hot", "_cold"))
        .select(*df.columns, *[F.col(f"_v.{c}").alias(c) for c in columns])
    )


def positions(
    df: DataFrame, key: str, order: str, previous: Sequence[str] = (), bucket: int = 4096
) -> DataFrame:
    """0-based ``position`` of each row in its key, and ``prev_x`` of the row before it.

    Rows are ranked inside buckets of ``order // bucket``; a table of one row
    per bucket carries counts and last values across bucket ends. A key of any
    size is thus spread over many tasks. ``order`` is unique in a key.
    """
    b = F.floor(F.col(order) / bucket).alias("_b")
    rows = df.withColumn("_b", b)
    heads = rows.groupBy(key, "_b").agg(
        F.count("*").alias("_n"),
        *[F.max_by(c, order).alias(f"_last_{c}") for c in previous],
    )
    by_bucket = W.partitionBy(key).orderBy("_b")
    heads = heads.select(
        key,
        "_b",
        F.coalesce(
            F.sum("_n").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        *[F.lag(f"_last_{c}").over(by_bucket).alias(f"_carry_{c}") for c in previous],
    )
    inside = W.partitionBy(key, "_b").orderBy(order)
    rn = F.row_number().over(inside)
    ranked = rows.select(
        "*", rn.alias("_rn"), *[F.lag(c).over(inside).alias(f"_lag_{c}") for c in previous]
    )
    return ranked.join(heads, [key, "_b"]).select(
        *df.columns,
        (F.col("_rn") - 1 + F.col("_offset")).cast("long").alias("position"),
        *[
            F.when(F.col("_rn") == 1, F.col(f"_carry_{c}"))
            .otherwise(F.col(f"_lag_{c}"))
            .alias(f"prev_{c}")
            for c in previous
        ],
    )


def variance_pop(n: Column, total: Column, squares: Column) -> Column:
    """Population variance from exact sums: (n * sum(x^2) - sum(x)^2) / n^2."""
    d = "decimal(38,0)"
    top = n.cast("decimal(18,0)") * squares.cast("decimal(20,0)") - total.cast(
        "decimal(19,0)"
    ) * total.cast("decimal(19,0)")
    return F.when(
        n > 0, top.cast(d).cast("double") / (n.cast("double") * n.cast("double"))
    ).otherwise(F.lit(0.0))


def histogram(values: DataFrame, column: str) -> DataFrame:
    """Each value (v) that is not null with its count (n), made once and kept."""
    v = F.col(column)
    return cut_lineage(values.where(v.isNotNull()).groupBy(v.cast("long").alias("v")).agg(F.count("*").alias("n")))


def value_at_ranks(hist: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """One row with sorted[floor(n * f)] for each fraction, and the midpoint median.

    ``hist`` counts the values, see :func:`histogram`. The running count is
    taken in ranges of 1024 values, plus one running count over the ranges.
    """
    hist = hist.withColumn("r", F.floor(F.col("v") / 1024))
    ranges = hist.groupBy("r").agg(F.sum("n").alias("rn"))
    all_ranges = W.orderBy("r")
    # One row per 1024 distinct values: text lengths below 50 M make at most 51,200 rows.
    ranges = ranges.select(
        "r",
        (F.sum("rn").over(all_ranges) - F.col("rn")).alias("base"),
        F.sum("rn").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("r").orderBy("v")
    cum = hist.join(ranges, "r").select(
        "v",
        "total",
        (F.col("base") + F.sum("n").over(inside)).alias("cum"),
        (F.col("base") + F.sum("n").over(inside) - F.col("n")).alias("below"),
    )

    def at(rank: Column) -> Column:
        return F.min(F.when((F.col("cum") > rank) & (F.col("below") <= rank), F.col("v")))

    total = F.col("total")
    low = F.floor((total - 1) / 2)
    high = F.floor(total / 2)
    return cum.agg(
        ((at(low) + at(high)) / 2.0).alias("median"),
        *[at(F.floor(total * F.lit(f))).alias(name) for name, f in fractions.items()],
    )
