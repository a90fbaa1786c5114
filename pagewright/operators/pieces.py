"""Token counts through a dictionary of pieces, and a store that keeps counts over runs.

A tokenizer of this family first cuts a text into pieces (a word with the space before it, a run of digits, of
signs, of white space) and merges bytes only inside a piece. The count of a text is the sum of those of its
pieces, and few different pieces make up very much text. So Spark cuts the texts, counts the different
pieces, has each encoded once, and joins the counts back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import tokens as K
from ..session import cut_lineage
from .keyed import SALTS, attach_by_key

#: Characters of a piece that are kept in the dictionary; longer ones, which hardly repeat, are known by digest.
LONG_PIECE = 256
#: Most pieces that are looked up by broadcast: the most frequent of those that hold one place in ``OFTEN`` or more,
#: which are never more than ``OFTEN``.
HOT_PIECES, OFTEN = 1 << 16, 1 << 20


#: White space of Unicode, which is what the tokenizer's ``\\s`` means; Java's is ASCII only.
_SPACE = r"\t-\r\x85\p{Z}"


def _unicode_space(pattern: str) -> str:
    """``pattern`` with ``\\s`` and ``\\S`` written out, inside and outside of classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{_SPACE}]")
        else:
            inside = inside if c == "\\" else c == "[" or (inside and c != "]")
            two = two if c == "\\" else c
            out.append(two)
            i += len(two)
            continue
        i += 2
    return "".join(out)


def pieces_of(text: Column, pre_split: str = K.PRE_SPLIT) -> Column:
    """The pieces of a text, in order; classes of characters are those of Unicode, as in the tokenizer."""
    return F.regexp_extract_all(text, F.lit(_unicode_space(pre_split)), F.lit(0))


def digest(text: Column) -> Column:
    """SHA-256 of a text as bytes, half as long as its digits."""
    return F.unhex(F.sha2(text, 256))


def _key(piece: Column) -> Column:
    """A short name of a piece: itself, or a digest if it is long."""
    return F.when(F.length(piece) <= LONG_PIECE, piece).otherwise(F.concat(F.lit("\x00"), F.sha2(piece, 256)))


def piece_dictionary(texts: DataFrame, text: str = "text", ranks_file: str | None = None, pre_split: str = K.PRE_SPLIT) -> DataFrame:
    """The different pieces of all texts: key, n (how often they stand there) and tokens, each encoded once."""
    each = texts.select(F.explode(pieces_of(F.col(text), pre_split)).alias("piece"))
    # Combined where they are read, so a frequent piece crosses the shuffle once for each task.
    distinct = each.groupBy("piece").agg(F.count("*").alias("n"))
    return distinct.select(_key(F.col("piece")).alias("key"), "n", K.token_count("piece", ranks_file, pre_split).alias("tokens"))


def count_texts(texts: DataFrame, ranks_file: str | None = None, pre_split: str = K.PRE_SPLIT) -> DataFrame:
    """(_key, _n, tokens) of the different texts in rows (_key, _text): how many rows have the text, and its count.

    Texts stay where they are. The most frequent pieces are looked up by broadcast and summed there; of the others, each
    task sends one row for each different piece of a text to the dictionary.
    """
    known = cut_lineage(piece_dictionary(texts, "_text", ranks_file, pre_split))
    places = known.agg(F.sum("n")).first()[0] or 0
    often = known.where(F.col("n") * OFTEN >= places).orderBy(F.col("n").desc(), "key").limit(HOT_PIECES)
    each = texts.select("_key", F.posexplode_outer(pieces_of(F.col("_text"), pre_split)).alias("pos", "piece"))
    keyed = each.select("_key", "pos", _key(F.col("piece")).alias("key"))
    met = keyed.join(F.broadcast(often.select("key", F.col("tokens").alias("_hot"))), "key", "left")
    sent = met.groupBy("_key", F.when(F.col("_hot").isNull(), F.col("key")).alias("key")).agg(
        F.count("*").alias("_times"),
        F.sum("_hot").alias("_sum"),
        F.count_if(F.coalesce(F.col("pos") == 0, F.lit(True))).alias("_n"),
    )
    # Rows without a piece to look up are spread over the tasks, and meet nothing there.
    salt = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("_key"), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    rare = known.select("key", F.lit(0).alias("_salt"), "tokens").hint("shuffle_hash")
    told = sent.withColumn("_salt", salt).join(rare, ["key", "_salt"], "left")
    total = F.coalesce("_sum", F.lit(0)) + F.col("_times") * F.coalesce("tokens", F.lit(0))
    sums = told.groupBy("_key").agg(F.sum("_n").alias("_n"), F.sum(total).alias("_sum"))
    # Rows of one text have the same pieces, so the sum over them divides.
    return sums.select("_key", "_n", F.expr("CAST(_sum div _n AS INT)").alias("tokens"))


def count_by_pieces(
    rows: DataFrame, spread_by: Sequence[str], text: str = "content", ranks_file: str | None = None, pre_split: str = K.PRE_SPLIT
) -> DataFrame:
    """Add ``tokens`` to rows; each different piece is encoded once.

    NULL counts 0. ``spread_by`` names columns that identify a row, see
    :func:`~pagewright.operators.tokens.count_with_reuse`.
    """
    # 128 bits: a key goes along with every rare piece of a text
    keyed = rows.withColumn("_key", F.substring(digest(F.col(text)), 1, 16))
    texts = keyed.where(F.col(text).isNotNull()).select("_key", F.col(text).alias("_text"))
    values = cut_lineage(count_texts(texts, ranks_file, pre_split))
    met = attach_by_key(keyed, values, ["_key"], "_n", ["tokens"], spread_by)
    return met.withColumn("tokens", F.coalesce("tokens", F.lit(0))).drop("_key")


class TokenStore:
    """Counts of texts by digest, kept under ``folder`` from run to run.

    A run counts only texts that no other run has counted, and adds those as its own part ``run=<id>``. Parts
    are written whole: what a run left that was stopped is not seen, and a run that is repeated under its
    id replaces its part and counts the same texts again. ``buckets`` is the number of
    digest ranges a part is sorted into, so that looking digests up reads the files that may hold them. A
    store belongs to one rank file and splitter.
    """

    SCHEMA = "digest string, tokens int, run string"

    def __init__(self, spark: SparkSession, folder: str, ranks_file: str | None = None, buckets: int = 16):
        self.spark, self.folder, self.ranks_file, self.buckets = spark, folder.rstrip("/"), ranks_file, buckets

    def known(self, without: str | None = None) -> DataFrame:
        """Digests (with tokens) that finished runs have counted, those of one run left out."""
        try:
            parts = self.spark.read.schema(self.SCHEMA).option("basePath", self.folder).parquet(f"{self.folder}/run=*")
        except AnalysisException:
            return self.spark.createDataFrame([], "digest string, tokens int")
        others = parts if without is None else parts.where(F.col("run") != without)
        # Two runs at the same time may both have counted a text; they agree.
        return others.groupBy("digest").agg(F.max("tokens").alias("tokens"))

    def count(self, rows: DataFrame, run: str, spread_by: Sequence[str], text: str = "content") -> DataFrame:
        """Add ``tokens`` and ``reused`` (whether an earlier run had counted the text) to rows; NULL counts 0."""
        if not run or not all(c.isalnum() or c in "-_." for c in run):
            raise ValueError("a run is named by letters, digits, '-', '_' and '.'")
        keyed = rows.withColumn("_key", digest(F.col(text)))
        full = keyed.where(F.col(text).isNotNull())
        known = self.known(without=run).select(F.unhex("digest").alias("_key"), "tokens")
        # Digests alone meet the store.
        old = cut_lineage(full.groupBy("_key").agg(F.count("*").alias("_n")).join(known, "_key"))
        fresh = full.select("_key", F.col(text).alias("_text"))
        if not old.isEmpty():
            by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(spread_by)]
            seen = attach_by_key(full.select("_key", F.col(text).alias("_text"), *by), old, ["_key"], "_n", ["tokens"], [f"_by{i}" for i in range(len(by))])
            # Kept, since it is cut for the dictionary and for the sums.
            fresh = cut_lineage(seen.where(F.col("tokens").isNull()).select("_key", "_text"))
        new = cut_lineage(count_texts(fresh, self.ranks_file))
        part = new.select(F.lower(F.hex("_key")).alias("digest"), "tokens")
        part.repartitionByRange(self.buckets, "digest").sortWithinPartitions("digest").write.mode("overwrite").parquet(f"{self.folder}/run={run}")
        told = old.select("_key", "_n", "tokens", F.lit(True).alias("reused")).unionByName(
            new.select("_key", "_n", "tokens", F.lit(False).alias("reused"))
        )
        met = attach_by_key(keyed, told, ["_key"], "_n", ["tokens", "reused"], spread_by)
        return met.withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "reused": F.coalesce("reused", F.lit(False))}).drop("_key")
