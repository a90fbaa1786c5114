"""Token counts as an Arrow function, and the columns derived from a count."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, ratio, round_half_up, warnings_of

# USD per 1000 tokens.
MODEL_PRICES = {
    "gpt-3.5-turbo": 0.0015,
    "gpt-4": 0.03,
    "gpt-4-turbo": 0.01,
    "text-embedding-ada-002": 0.0001,
    "text-embedding-3-small": 0.00002,
    "text-embedding-3-large": 0.00013,
}
DEFAULT_MODEL = "gpt-3.5-turbo"

#: Splits text before merges; the public pattern of the r50k family.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_ranks() -> str:
    """Path of the locally installed public byte-level rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _encoder(ranks_file: str, pre_split: str):
    """One encoder per Python worker; tasks in the same worker reuse it."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding(
        name=os.path.basename(ranks_file), pat_str=pre_split, mergeable_ranks=ranks, special_tokens={}
    )


def count_tokens_of(text: str, ranks_file: str | None = None, pre_split: str = PRE_SPLIT) -> int:
    """Token count of one string; usable as a chunk length function."""
    return len(_encoder(ranks_file or default_ranks(), pre_split).encode_ordinary(text)) if text else 0


def token_counter(ranks_file: str | None = None, pre_split: str = PRE_SPLIT) -> Callable[[str], int]:
    """:func:`count_tokens_of` with the rank file named here, where the job is planned, as a function for tasks."""
    return partial(count_tokens_of, ranks_file=ranks_file or default_ranks(), pre_split=pre_split)


def token_count(text: Column | str, ranks_file: str | None = None, pre_split: str = PRE_SPLIT) -> Column:
    """Tokens of a text column, 0 for NULL and ''. The rank file must exist on every worker."""
    path = ranks_file or default_ranks()

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = _encoder(path, pre_split).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int32())

    return count(col(text))


def price_of(model: Column | str, overrides: dict[str, float] | None = None) -> Column:
    """USD per 1000 tokens from the fixed price list and the caller's overrides; 0 if unknown."""
    prices = {**MODEL_PRICES, **(overrides or {})}
    table = F.map_from_arrays(
        F.array(*[F.lit(m) for m in prices]), F.array(*[F.lit(float(p)) for p in prices.values()])
    )
    return F.coalesce(F.element_at(table, col(model)), F.lit(0.0))


def cost(tokens: Column | str, price: Column) -> Column:
    return round_half_up(col(tokens).cast("double") / 1000.0 * price, 5)


def tokens_per_char(tokens: Column, characters: Column) -> Column:
    return round_half_up(ratio(tokens, characters), 3)


def tokens_per_word(tokens: Column, words: Column) -> Column:
    return round_half_up(ratio(tokens, words), 2)


def token_warnings(tokens: Column, characters: Column) -> Column:
    return warnings_of(
        (characters == 0, "Empty text provided"),
        (
            tokens > 8000,
            F.concat(
                F.lit("High token count ("), tokens.cast("string"), F.lit(") may exceed model limits")
            ),
        ),
        (
            ratio(tokens, characters) > 0.5,
            "High tokens-per-character ratio suggests complex text",
        ),
    )
