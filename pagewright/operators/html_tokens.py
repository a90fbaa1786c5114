"""Pages to token rows, matching of open and close tags, and noise removal.

All steps partition by the page id. A table of pages that is hash partitioned by
page id is exploded in place, so the windows that follow need no further
shuffle. A window partition is one page, which the size gate bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Comments; whole script and style elements; tags, where a quoted attribute may
# hold ">"; other "<" constructs; text; a stray "<". Every branch after "=" is
# told apart by its next character, so a truncated tag does not backtrack; the loop
# over attributes is possessive, which Java runs without recursion however many there are.
TOKEN = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"""|</?[a-z][^>=]*(?:=\s*"[^"]*"[^>=]*|=\s*'[^']*'[^>=]*|=\s*[^\s"'>=][^>=]*|=\s*)*+>"""
    r"|</?[a-z][^>]*>|<[/!?][^>]*>|[^<]+|<"
)
#: With an empty token where the page ends.
TOKEN_OR_END = TOKEN + r"|\z"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9:\-]*)"

# Fixed values of the HTML standard: elements without content, and removed elements.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
)
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside")


def _kind(raw: Column, tag: Column) -> Column:
    return (
        F.when((tag == "") & raw.rlike("^<[!?/]"), "comment")
        .when(tag == "", "text")
        .when(raw.startswith("</"), "close")
        .when(tag.isin("script", "style"), "raw")
        .when(tag.isin(*VOID_TAGS), "void")
        .otherwise("open")
    )


def tokenize(
    pages: DataFrame, html: str = "html", key: str = "page_id", carry: Sequence[str] = ()
) -> DataFrame:
    """Token rows (key, pos, raw, tag, kind); the raw tokens in order are the page.

    The columns in ``carry`` travel as one struct ``page`` on the first token of a
    page, so that an aggregate by page gets them back without a join. A page
    without tokens keeps one row with an empty token.
    """
    # The outer form keeps the optimizer from running the pattern a second time in
    # an inferred size(...) > 0 filter.
    exploded = pages.select(
        key, *carry,
        F.posexplode_outer(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("pos", "raw"),
    )
    pos, raw = F.coalesce("pos", F.lit(0)), F.coalesce("raw", F.lit(""))
    extra = [F.when(pos == 0, F.struct(*carry)).alias("page")] if carry else []
    rows = exploded.select(key, pos.alias("pos"), raw.alias("raw"), *extra)
    return rows.withColumn("tag", F.lower(F.regexp_extract("raw", TAG_NAME, 1))).withColumn(
        "kind", _kind(F.col("raw"), F.col("tag"))
    )


def tags_with_text(tokens: Column) -> Column:
    """What ``TOKEN_OR_END`` finds, as (pos, raw, text): each tag with the text after it, so that windows see half the rows.

    Text without a tag before it (at the start, after a stray "<") stands in ``raw`` by itself, as does the end.
    """
    def is_tag(raw: Column) -> Column:
        return raw.startswith("<") & (raw != "<")

    def entry(raw: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)
        text = F.when(is_tag(raw) & ~after.startswith("<"), after).otherwise("")
        told = ~raw.startswith("<") & (raw != "") & is_tag(F.get(tokens, i - 1))
        return F.struct(i.alias("pos"), raw.alias("raw"), text.alias("text"), told.alias("told"))

    return F.filter(F.transform(tokens, entry), lambda e: ~F.coalesce(e["told"], F.lit(False)))


def tokenize_tags(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """As :func:`tokenize`, one row for a tag and the text after it: (key, pos, raw, text, tag, kind)."""
    found = pages.select(key, F.regexp_extract_all(html, F.lit(TOKEN_OR_END), F.lit(0)).alias("_tokens"))
    exploded = found.select(key, F.explode_outer(tags_with_text(F.col("_tokens"))).alias("e"))
    rows = exploded.select(
        key, F.coalesce("e.pos", F.lit(0)).alias("pos"),
        *[F.coalesce(f"e.{c}", F.lit("")).alias(c) for c in ("raw", "text")],
    )
    return rows.withColumn("tag", F.lower(F.regexp_extract("raw", TAG_NAME, 1))).withColumn("kind", _kind(F.col("raw"), F.col("tag")))


def pair_tags(tokens: DataFrame, carry: Sequence[str] = (), key: str = "page_id") -> DataFrame:
    """Match open and close tags of the same name.

    The running level of each tag name is kept per page; an open tag and the
    next close tag on its level are a pair. Adds ``mate``, the position of the
    other tag, NULL for unmatched ones, and for each carried column ``x``
    ``mate_x``, its value on the other tag.
    """
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    by_tag = W.partitionBy(key, "tag").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    levelled = tokens.withColumn("_level", F.sum(step).over(by_tag)).withColumn(
        "_level", F.when(closes, F.col("_level") + 1).when(opens, F.col("_level"))
    )
    by_level = W.partitionBy(key, "tag", "_level").orderBy("pos")
    seen = {"kind": F.col("kind"), "pos": F.col("pos"), **{c: F.col(c) for c in carry}}
    named = levelled.select(
        "*",
        *[F.lead(v).over(by_level).alias(f"_next_{n}") for n, v in seen.items()],
        *[F.lag(v).over(by_level).alias(f"_prev_{n}") for n, v in seen.items()],
    )
    down = opens & (F.col("_next_kind") == "close")
    up = closes & (F.col("_prev_kind") == "open")
    mates = {
        ("mate" if n == "pos" else f"mate_{n}"): F.when(down, F.col(f"_next_{n}")).when(up, F.col(f"_prev_{n}"))
        for n in seen
        if n != "kind"
    }
    return named.select(*tokens.columns, *[v.alias(n) for n, v in mates.items()])


def running_depth(tags: Sequence[str], key: str = "page_id") -> Column:
    """How many matched elements of these names are open at a token, itself included."""
    inside = F.col("tag").isin(*tags) & F.col("mate").isNotNull()
    step = F.when(inside & (F.col("kind") == "open"), 1).when(inside & (F.col("kind") == "close"), -1).otherwise(0)
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return F.sum(step).over(w)


def without_noise(tokens: DataFrame, tags: Sequence[str] = NOISE_TAGS, key: str = "page_id") -> DataFrame:
    """Tokens outside the removed elements; ``tokens`` come from :func:`pair_tags`."""
    closing = F.col("tag").isin(*tags) & (F.col("kind") == "close")
    marked = tokens.withColumn("_noise", running_depth(tags, key))
    kept = (F.col("_noise") == 0) & ~closing & ~F.col("kind").isin("raw", "comment")
    return marked.where(kept).drop("_noise")
