"""A partitioned Bloom filter of keys that were seen, tested before the exact check.

A hop of a crawl asks which of the URLs it found are new. An anti-join with all URLs seen so far shuffles them all, hop
after hop. The filter has ten bits for each key instead, in parts of ``PART_BITS``: a key belongs to one part, so
candidates meet the parts by an equality join, and nothing grows on one node. What the filter has not seen is
new for sure; only the rest, the seen ones and about one new key in a hundred, is checked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a part, bits for each expected key, and places each key sets.
PART_BITS = 1 << 16
BITS_PER_KEY = 10
PLACES = 7
_WORDS = PART_BITS // 64


def parts_for(expected: int) -> int:
    """Parts for about so many keys. More keys make the filter less selective, not wrong."""
    return max(1, -(-expected * BITS_PER_KEY // PART_BITS))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _places(key: Column) -> list[Column]:
    """Places of a key in its part: two hashes, combined."""
    a, b = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key).bitwiseOR(F.lit(1))
    return [F.pmod(F.shiftright(a, 32) + F.shiftright(b, 32) * k, F.lit(PART_BITS)).cast("int") for k in range(PLACES)]


def build_filter(keys: DataFrame, key: str, parts: int) -> DataFrame:
    """(part, words): the bits of each part as an array of longs. Null keys are not entered."""
    spark = keys.sparkSession
    places = keys.where(F.col(key).isNotNull()).select(
        _part(F.col(key), parts).alias("part"), F.explode(F.array(*_places(F.col(key)))).alias("place")
    )
    bit = F.expr("shiftleft(1L, place & 63)")
    none = spark.range(parts * _WORDS).select(
        F.floor(F.col("id") / _WORDS).cast("int").alias("part"), (F.col("id") % _WORDS).cast("int").alias("word"), F.lit(0).cast("long").alias("bits")
    )
    words = places.select("part", F.shiftright("place", 6).alias("word"), bit.alias("bits")).unionByName(none)
    each = words.groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return each.groupBy("part").agg(F.transform(ordered, lambda w: w["bits"]).alias("words"))


def merge_filters(a: DataFrame, b: DataFrame) -> DataFrame:
    """The keys of both; they must have the same number of parts."""
    other = b.select("part", F.col("words").alias("_words"))
    return a.join(other, "part").select("part", F.zip_with("words", "_words", lambda x, y: x.bitwiseOR(y)).alias("words"))


def with_maybe_seen(candidates: DataFrame, seen: DataFrame, key: str, parts: int) -> DataFrame:
    """``candidates`` with ``maybe_seen``: false only for keys that were not entered."""
    hit = F.lit(True)
    for place in _places(F.col(key)):
        word = F.get(F.col("_words"), F.shiftright(place, 6))
        hit &= F.expr("1L") == F.call_function("shiftright", word, place.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long"))
    filters = seen.select(F.col("part").alias("_part"), F.col("words").alias("_words"))
    met = candidates.withColumn("_part", _part(F.col(key), parts)).join(filters, "_part", "left")
    return met.select(*candidates.columns, F.coalesce(hit, F.lit(False)).alias("maybe_seen"))


def unseen(candidates: DataFrame, visited: DataFrame, seen: DataFrame, key: str, parts: int) -> DataFrame:
    """The rows of ``candidates`` whose key is not in ``visited``, exactly; ``seen`` is a filter that holds
    all keys of ``visited``. Only rows it may have seen take part in the anti-join."""
    flagged = with_maybe_seen(candidates, seen, key, parts)
    fresh = flagged.where(~F.col("maybe_seen")).drop("maybe_seen")
    checked = flagged.where("maybe_seen").drop("maybe_seen").join(visited.select(key), key, "left_anti")
    return fresh.unionByName(checked)
