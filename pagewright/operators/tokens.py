"""Token columns on chunk rows, totals, distribution and reuse of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions.core import round_half_up
from ..session import cut_lineage
from .keyed import attach_by_key, histogram, value_at_ranks, variance_pop


def with_tokens(
    rows: DataFrame,
    text: str = "content",
    model: str = K.DEFAULT_MODEL,
    prices: dict[str, float] | None = None,
    ranks_file: str | None = None,
    counted: str | None = None,
) -> DataFrame:
    """Add tokens, word_count, cost, ratios and warnings. NULL text counts 0 and says so.

    ``counted`` names a column with counts that were taken where the text was cut (``count`` of
    :func:`.chunking.chunk_documents`); without it every text is encoded here.
    """
    tokens = K.token_count(text, ranks_file) if counted is None else F.coalesce(counted, F.lit(0))
    return with_token_columns(rows.withColumn("tokens", tokens), text, model, prices)


def with_token_columns(
    rows: DataFrame, text: str, model: str = K.DEFAULT_MODEL, prices: dict[str, float] | None = None
) -> DataFrame:
    """The columns that follow from a given ``tokens`` column."""
    t, bad = F.col("tokens"), F.col(text).isNull()
    characters = F.coalesce(F.length(text), F.lit(0))
    return rows.withColumn("word_count", T.word_count(text)).withColumns(
        {
            "tokens_per_character": K.tokens_per_char(t, characters),
            "tokens_per_word": K.tokens_per_word(t, F.col("word_count")),
            "model": F.lit(model),
            "cost": K.cost(t, K.price_of(F.lit(model), prices)),
            "token_warnings": F.when(bad, F.array(F.lit("Invalid text format"))).otherwise(
                K.token_warnings(t, characters)
            ),
        }
    )


def price_join(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join on ``model`` with a price table (model, usd_per_1k); unknown models cost 0.

    A model with several prices takes the highest. The join is left to adaptive execution,
    which broadcasts a small table and splits a model that holds very many rows.
    """
    once = prices.groupBy("model").agg(F.max("usd_per_1k").alias("usd_per_1k"))
    joined = rows.join(once, "model", "left")
    price = F.coalesce("usd_per_1k", F.lit(0.0))
    return joined.withColumn("cost", K.cost("tokens", price)).drop("usd_per_1k")


def count_with_reuse(
    rows: DataFrame,
    spread_by: Sequence[str],
    text: str = "content",
    ranks_file: str | None = None,
) -> DataFrame:
    """Add ``tokens``, counting each distinct text once, and ``copies`` of the text.

    Texts are keyed by a digest of the whole text. The digest is joined back with
    the most frequent texts broadcast, so a text that makes up a third of all
    rows does not land in one task. ``spread_by`` names columns that identify a row.
    """
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    # Kept, since both sides of the look-up read it: each text is counted once.
    distinct = cut_lineage(
        keyed.where(F.col(text).isNotNull())
        .groupBy("_key")
        .agg(F.any_value(text).alias("_text"), F.count("*").alias("_n"))
        .select("_key", "_n", K.token_count("_text", ranks_file).alias("tokens"))
    )
    return (
        attach_by_key(keyed, distinct, ["_key"], "_n", ["tokens", "_n"], spread_by)
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("copies", F.coalesce("_n", F.lit(0)))
        .drop("_key", "_n")
    )


def batch_totals(rows: DataFrame) -> DataFrame:
    """One row of totals, averages and ratios over tokens, length, word_count and cost."""
    n, total = F.col("n"), F.col("total_tokens")
    t = F.col("tokens").cast("long")
    agg = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(t), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)).alias("total_characters"),
        F.coalesce(F.sum(F.col("word_count").cast("long")), F.lit(0)).alias("total_words"),
        # costs are whole hundred-thousandths, so the sum is exact in integers
        F.coalesce(F.sum(F.round(F.col("cost") * 100000).cast("long")), F.lit(0)).alias("_cost"),
        F.coalesce(F.min(t), F.lit(0)).alias("min_tokens"),
        F.coalesce(F.max(t), F.lit(0)).alias("max_tokens"),
        F.coalesce(F.sum(t * t), F.lit(0)).alias("_sq"),
    )
    variance = variance_pop(n, total, F.col("_sq"))

    def over(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return agg.select(
        n.alias("chunks"),
        "total_tokens",
        "total_characters",
        "total_words",
        F.coalesce(round_half_up(F.try_divide(total, n)), F.lit(0)).alias("average_tokens"),
        (F.col("_cost") / 100000.0).alias("total_cost"),
        "min_tokens",
        "max_tokens",
        over("total_tokens", "total_characters").alias("tokens_per_character"),
        over("total_tokens", "total_words").alias("tokens_per_word"),
        variance.alias("variance"),
        F.sqrt(variance).alias("standard_deviation"),
    )


def token_distribution(rows: DataFrame) -> DataFrame:
    """Median, lower and upper quartile by rank, population variance and deviation."""
    hist = histogram(rows, "tokens")  # all follows from it, so the rows are read once
    n, v = F.col("n"), F.col("v")
    variance = variance_pop(F.coalesce(F.sum("n"), F.lit(0)), F.sum(v * n), F.sum(v * v * n))
    moments = hist.agg(variance.alias("variance"), F.sqrt(variance).alias("standard_deviation"))
    ranks = value_at_ranks(hist, {"q1": 0.25, "q3": 0.75})
    # two tables of one row each, put side by side without a join
    both = ranks.unionByName(moments, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
