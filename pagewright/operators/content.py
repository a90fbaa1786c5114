"""The main content of a page: scored regions, a fallback by selectors, and the gates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html as H
from ..functions.core import NON_WS, WS, is_blank, let, squeezed
from ..params import PageJobParams
from ..session import cut_lineage_in_layout
from .html_tokens import NOISE_TAGS, pair_tags, tokenize_tags

# Selectors of the fallback, in order of preference.
FALLBACK_SELECTORS = (
    "main", "article", ".content", "#content", ".main-content", ".post-content",
    ".entry-content", ".article-content", ".page-content", ".post", ".entry",
    ".article", "body",
)

# What the primary pick looks at.
CONTAINERS = ("article", "main", "section", "div", "td", "body")
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
)
# Weights and names are our own choice. Names for content are the words of the fallback selectors; names
# against it are the removed elements, the landmark roles of the ARIA standard, and a few words beside them.
TAG_WEIGHT = {"article": 10, "main": 10}
GOOD_NAME = "(?i)" + "|".join(sorted({w for s in FALLBACK_SELECTORS for w in s.strip(".#").split("-")} - {"body"}))
LANDMARKS = ("banner", "complementary", "contentinfo", "navigation", "search")
BAD_NAME = "(?i)" + "|".join((*NOISE_TAGS[2:], *LANDMARKS, r"\bads?\b", "advert", "comment", "cookie", "menu", "share", "sidebar"))
NAME_WEIGHT = 20
MIN_BLOCK = 25
#: Pages with less html are not parsed.
MIN_PAGE_LENGTH = 100
# What a block of text gives the box around it and the next two out: all, a half and a quarter.
POINT_SHARES = (1.0, 0.5, 0.25)


def _selector_rank(tag: Column, classes: Column, ident: Column) -> Column:
    """Place of the first fallback selector an open tag matches, NULL for none."""
    ranks = F.from_json(
        F.lit(json.dumps({sel: i for i, sel in enumerate(FALLBACK_SELECTORS)})), "map<string,int>"
    )
    names = F.concat(
        F.array(tag, F.concat(F.lit("#"), F.coalesce(ident, F.lit("")))),
        F.transform(
            F.split(F.coalesce(classes, F.lit("")), f"{WS}+"), lambda c: F.concat(F.lit("."), c)
        ),
    )
    return F.array_min(F.transform(names, lambda n: F.element_at(ranks, n)))


def _features(tokens: DataFrame) -> DataFrame:
    """Narrow rows of tags with the text after them: no raw text goes through the window sorts."""
    raw, tag, opens = F.col("raw"), F.col("tag"), F.col("kind") == "open"
    with_names = opens & raw.contains("=")
    tokens = tokens.withColumns(
        {
            "_size": F.length(F.when(F.col("kind") == "text", raw).otherwise(F.col("text"))),
            "_text": squeezed(F.when(F.col("kind") == "text", raw).otherwise(F.col("text"))),
            "_class": F.when(with_names, H.raw_attribute(raw, "class")),
            "_id": F.when(with_names, H.raw_attribute(raw, "id")),
        }
    )
    text, name = F.col("_text"), F.concat_ws(" ", "_class", "_id")
    name_weight = F.when(
        opens & tag.isin(*CONTAINERS),
        F.when(name.rlike(BAD_NAME), -NAME_WEIGHT).otherwise(0)
        + F.when(name.rlike(GOOD_NAME), NAME_WEIGHT).otherwise(0),
    ).otherwise(0)
    return tokens.select(
        "page_id", "pos", "tag", "kind",
        F.when(F.col("kind") == "text", 0).otherwise(F.length(raw)).alias("size"),
        F.col("_size").alias("text_size"),
        F.length(F.when(text.rlike(NON_WS), text).otherwise("")).alias("chars"),
        F.regexp_count(text, F.lit("[,，、]")).alias("commas"),
        F.when(
            with_names | (opens & tag.isin(*FALLBACK_SELECTORS)),
            _selector_rank(tag, F.col("_class"), F.col("_id")),
        ).alias("selector"),
        name_weight.alias("name_weight"),
    )


def content_regions(pages: DataFrame) -> DataFrame:
    """Primary region and fallback candidates of pages (page_id, html), as character ranges: page_id, primary, candidates.

    One pass over the tokens of a page, without joins; all sorts and aggregates
    are by page_id, over places and sizes only, no text among them. A page without either has no row.

    Blocks of running text of at least 25 characters score
    ``1 + commas + min(chars / 100, 3)`` for the element around them, half of it
    for the next one out and a quarter for the one after. Tag and class weights
    are added, and the share of text outside links scales the sum.
    """
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    tokens = _features(tokenize_tags(pages))
    link = F.when(F.col("tag") == "a", F.col("kind"))
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"

    # Running offsets and text sizes, and text inside links: up to the tag, so without the text after it.
    flat = tokens.select(
        "page_id", "pos", "tag", "kind", "size", "chars", "commas", "selector", "name_weight",
        (F.sum(F.col("size") + F.col("text_size")).over(w) - F.col("text_size")).alias("end"),
        (F.sum("chars").over(w) - F.col("chars")).alias("cum"),
        F.coalesce(F.last(link, ignorenulls=True).over(w) == "open", F.lit(False)).alias("in_link"),
    )
    link_chars = F.when(F.col("in_link"), F.col("chars")).otherwise(0)
    flat = flat.withColumn("cum_link", F.sum(link_chars).over(w) - link_chars).drop("in_link")
    paired = pair_tags(flat, ["end", "size", "cum", "cum_link"])

    # An unclosed body reaches to the page end; other unclosed boxes are not boxes.
    matched = F.col("mate").isNotNull()
    body_end = (F.col("tag") == "body") & is_open & ~matched
    box = F.col("tag").isin(*CONTAINERS) & (matched | body_end)
    noise = F.col("tag").isin(*NOISE_TAGS) & matched
    step = F.when(is_open, 1).when(is_close, -1).otherwise(0)
    box_step = F.when(box, step).otherwise(0)
    nested = paired.select(
        "*",
        F.sum(box_step).over(w).alias("level"),
        F.sum(F.when(noise, step).otherwise(0)).over(w).alias("noise"),
        (box & is_open).alias("is_box"),
        (F.col("tag").isin(*BLOCK_TAGS) | F.lead("pos").over(W.partitionBy("page_id").orderBy("pos")).isNull()).alias("ends"),
    )

    # A block tag, or the last token, ends the block of text before it. What the
    # block holds is the difference of running sums since the block tag before.
    heard = (F.col("noise") == 0) & (F.col("level") > 0)
    summed = nested.select(
        "*",
        (F.col("level") - box_step).alias("block_level"),
        *[
            (F.sum(F.when(heard, F.col(c)).otherwise(0)).over(w) - F.when(heard, F.col(c)).otherwise(0)).alias(name)
            for c, name in (("chars", "heard"), ("commas", "heard_commas"))
        ],
    )

    def since(c: str) -> Column:
        return F.col(c) - F.coalesce(
            F.last(F.when(F.col("ends"), F.col(c)), ignorenulls=True).over(before), F.lit(0)
        )

    sized = summed.select("*", since("heard").alias("block_chars"), since("heard_commas").alias("block_commas"))
    points = 1 + F.col("block_commas") + F.least(F.floor(F.col("block_chars") / 100), F.lit(3))
    sized = sized.withColumn(
        "points", F.when(F.col("ends") & (F.col("block_chars") >= MIN_BLOCK), points.cast("double"))
    )

    # One stream of events. A box is an event on its own level. A block is an event
    # on the level of the box around it and on the next two levels out, with its
    # share of points. On each level the last box before a block is its ancestor.
    # Candidates pass through on level 0.
    def event(role: str, level: Column, value: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), level.cast("int").alias("level"), value.alias("value"))

    level, around = F.col("level"), F.col("block_level")
    blocks = [
        F.when(F.col("points").isNotNull() & (around > up), event("block", around - up, F.col("points") * share))
        for up, share in enumerate(POINT_SHARES)
    ]
    events = F.array_compact(
        F.array(
            F.when(F.col("is_box"), event("box", level, F.lit(0.0))),
            F.when(F.col("selector").isNotNull(), event("candidate", F.lit(0), F.lit(0.0))),
            *blocks,
        )
    )
    region = F.struct(
        F.col("end").cast("int").alias("region_start"),
        F.coalesce(F.col("mate_end") - F.col("mate_size"), F.lit(H.MAX_HTML)).cast("int").alias("region_end"),
    )
    # NULL for an unclosed body, whose link share counts as 0
    box_chars, box_link = F.col("mate_cum") - F.col("cum"), F.col("mate_cum_link") - F.col("cum_link")
    weight = F.lit(0)
    for tag, value in TAG_WEIGHT.items():
        weight = F.when(F.col("tag") == tag, value).otherwise(weight)
    facts = F.struct(
        F.col("pos").alias("pos"),
        region.alias("region"),
        (weight + F.col("name_weight")).cast("double").alias("weight"),
        F.when(box_chars > 0, box_link / box_chars).otherwise(0.0).alias("density"),
    )
    stream = sized.select(
        "page_id", "pos", "selector", facts.alias("facts"), events.alias("events")
    ).select(
        "page_id", "pos", "selector", "facts", F.explode_outer("events").alias("e")
    ).where(F.col("e").isNotNull()).select("page_id", "pos", "selector", "facts", "e.*")
    is_box_event = F.col("role") == "box"
    on_level = (
        W.partitionBy("page_id", "level").orderBy("pos", is_box_event.desc()).rowsBetween(W.unboundedPreceding, 0)
    )
    # Level 0 has no boxes, so there ``facts`` stays that of the row itself.
    ancestor = F.last(F.when(is_box_event, F.col("facts")), ignorenulls=True).over(on_level)
    owned = stream.select(
        "page_id", "selector", "value",
        F.when(F.col("role") == "block", ancestor).otherwise(F.col("facts")).alias("facts"),
        (F.col("role") == "candidate").alias("is_candidate"),
    ).where(F.col("facts").isNotNull())
    # The facts of a region are the same on all its rows. Numbers are aggregated by hash, a struct of them by sort.
    per_region = owned.groupBy("page_id", "is_candidate", F.col("facts.pos").alias("pos")).agg(
        F.sum("value").alias("points"),
        F.max("selector").alias("selector"),
        *[F.max(f"facts.region.{c}").alias(c) for c in ("region_start", "region_end")],
        *[F.max(f"facts.{c}").alias(c) for c in ("weight", "density")],
    )
    region = F.struct("region_start", "region_end").alias("region")
    score = (F.col("points") + F.col("weight")) * (1 - F.col("density"))
    primary = F.when(
        ~F.col("is_candidate") & (F.col("points") > 0) & (score > 0),
        F.struct(score.alias("score"), (-F.col("pos")).alias("order"), region),
    )
    candidate = F.when(F.col("is_candidate"), F.struct("selector", "pos", region))
    return per_region.groupBy("page_id").agg(
        F.array_max(F.collect_list(primary)).alias("primary"), F.collect_list(candidate).alias("candidates")
    )


def _slice(html: Column, region: Column) -> Column:
    start = region["region_start"]
    return F.substring(html, start + 1, region["region_end"] - start)


def extract_content(
    pages: DataFrame, params: PageJobParams | None = None, use_primary: bool = True
) -> DataFrame:
    """Main content per page: method, html, text, excerpt, byline, read time, error.

    ``page_id`` must name one row each (see :func:`with_row_key`), and ``pages`` should be
    laid out by it (see :func:`by_page`). Columns besides page_id, url and html are kept. The primary
    region counts if its text reaches the threshold. Otherwise every candidate
    of the selectors is scored; this happens only on pages that need it, or on all
    of them without ``use_primary``.
    """
    p = params or PageJobParams()
    html = F.col("html")
    others = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    # Facts of the whole page first. A page that fails a gate is not parsed.
    facts = pages.select(
        "page_id", "url", "html", *others,
        H.title_tag("html").alias("_title"),
        H.meta_content("html", "author").alias("_author"),
        H.meta_content("html", "description").alias("_description"),
        F.length(H.body_text("html")).alias("_body"),
    ).select(
        "page_id", "url", *others,
        H.title_or_domain(F.col("_title"), F.col("url")).alias("title"),
        "_author", "_description",
        _before_error(p, F.col("_body")).alias("_gate"),
        "html",
    ).withColumn("html", F.when(F.col("_gate").isNull(), html))
    # Regions are found on narrow rows in the layout of the pages, which meet them there: pages are
    # not sorted, and where they are laid out by page_id neither side moves.
    regions = content_regions(facts.select("page_id", "html"))
    placed = facts.join(regions.hint("shuffle_hash"), "page_id", "left")
    first = placed.withColumn("_p_html", _slice(html, F.col("primary.region"))).withColumn(
        "_p_text", H.strip_to_text("_p_html")
    )
    reaches = F.coalesce(F.length("_p_text") >= p.char_threshold, F.lit(False)) & F.lit(use_primary)

    def scored(c: Column) -> Column:
        content = _slice(html, c["region"])

        def rated(text: Column) -> Column:
            return F.when(F.length(text) >= p.char_threshold, H.content_score(text, content))

        return F.struct(
            let(H.strip_to_text(content), rated).alias("score"),
            (-c["selector"]).alias("s"), (-c["pos"]).alias("o"),
            c["region"].alias("region"),
        )

    candidates = F.coalesce("candidates", F.array())
    best = F.array_max(F.filter(F.transform(candidates, scored), lambda c: c["score"] > 0))
    allowed = ~reaches & F.lit(p.enable_fallback)
    second = first.withColumn("_ok", reaches).withColumn("_best", F.when(allowed, best))
    picked = second.withColumn(
        "content_html", F.when(F.col("_ok"), F.col("_p_html")).otherwise(_slice(html, F.col("_best.region")))
    )
    names = F.array(*[F.lit(s) for s in FALLBACK_SELECTORS])
    selector = F.when(
        F.col("_best").isNotNull(), F.element_at(names, (1 - F.col("_best.s")).cast("int"))
    )
    done = picked.withColumns(
        {
            "content_text": F.when(F.col("_ok"), F.col("_p_text")).otherwise(
                F.when(F.col("_best").isNotNull(), H.strip_to_text("content_html"))
            ),
            "method": F.when(F.col("_ok"), "readability").otherwise(
                F.concat(F.lit("fallback-"), selector)
            ),
            "fallback_used": F.coalesce(~F.col("_ok") & F.col("_best").isNotNull(), F.lit(False)),
        }
    )
    excerpt = H.excerpt("content_text")
    primary = F.col("_ok")
    return done.select(
        "page_id", "url", *others, "title", "content_html", "content_text", "method", "fallback_used",
        F.when(primary, F.col("_author")).otherwise("").alias("byline"),
        F.when(primary & ~is_blank("_description"), F.col("_description")).otherwise(excerpt).alias("excerpt"),
        H.read_time(F.length("content_text"), F.col("fallback_used")).cast("int").alias("read_time"),
        "_gate",
    )


# Stages and messages of the gates below.
def _gate(stage: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(stage).alias("stage"), text.alias("message"))


def _before_error(p: PageJobParams, n: Column) -> Column:
    """Why a page is not parsed: it is invalid or its body text, ``n`` characters, is too short."""
    error = H.html_error("html")
    return F.when(
        F.length("html") < MIN_PAGE_LENGTH,
        _gate("extraction", "Page content is empty or too short"),
    ).when(
        error.isNotNull(),
        _gate("parsing", F.concat(F.lit("HTML parsing failed: HTML validation failed: "), error)),
    ).when(
        n < p.min_content_length,
        _gate("parsing", F.concat(
            F.lit("HTML parsing failed: Content too short: "), n.cast("string"),
            F.lit(f" characters (minimum: {p.min_content_length})"),
        )),
    )


def gate_content(content: DataFrame, params: PageJobParams | None = None) -> DataFrame:
    """Add status, error_stage and error from the checks before, between and after the steps.

    ``content`` holds the columns of :func:`extract_content` with ``markdown`` and ``text_content``.
    """
    p = params or PageJobParams()
    n = F.length("text_content")
    gate = (
        F.when(F.col("_gate").isNotNull(), F.col("_gate"))
        .when(
            F.col("content_html").isNull(),
            _gate("extraction", "Content extraction failed: No suitable content found with any fallback method"),
        )
        .when(is_blank("markdown"), _gate("validation", "Final result has no Markdown content"))
        .when(is_blank("text_content"), _gate("validation", "Final result has no text content"))
        .when(
            n < p.min_content_length,
            _gate("validation", F.concat(F.lit("Final content too short: "), n.cast("string"), F.lit(" characters"))),
        )
        .when(
            n > p.max_content_length,
            _gate("validation", F.concat(F.lit("Final content too long: "), n.cast("string"), F.lit(" characters"))),
        )
    )
    return content.withColumn("_g", gate).select(
        *[c for c in content.columns if c != "_gate"],
        F.when(F.col("_g").isNull(), "success").otherwise("extraction_failed").alias("status"),
        F.col("_g.stage").alias("error_stage"),
        F.col("_g.message").alias("error"),
    )


#: Stored bytes of pages per partition, and the most partitions one shuffle should have.
PARTITION_BYTES = 16 * 1024 * 1024
MAX_PARTITIONS = 200_000
#: Spark estimates this and more for plans whose size it does not know.
UNKNOWN_SIZE = 2**60


def by_page(pages: DataFrame) -> DataFrame:
    """Lay pages out by page_id, the one shuffle of whole pages.

    Whole pages move, not their tokens. All windows and aggregates of the job are
    by page_id and stay inside these partitions. Their number follows the size of
    the input, and a small input still uses every core.
    """
    spark = pages.sparkSession
    plan = pages._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    # A task of this job spends over a second on compiling its many window steps, so
    # there are no more tasks than cores unless the input is large.
    known = size < UNKNOWN_SIZE
    wanted = size // PARTITION_BYTES if known else int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Full rounds of tasks: a few tasks over would leave most cores waiting for them.
    cores = spark.sparkContext.defaultParallelism
    n = min(max(cores, -(-wanted // cores) * cores), MAX_PARTITIONS)
    return pages.repartition(n, "page_id")


def laid_out(pages: DataFrame) -> DataFrame:
    """Pages laid out by page_id and written in that layout, for steps that read them more than once.

    Also what makes keys of :func:`with_row_key` lasting where the order of the input's rows is not: a
    repeated task reads the rows with the keys they were given.
    """
    return cut_lineage_in_layout(by_page(pages))


def with_row_key(pages: DataFrame) -> DataFrame:
    """Pages under a key of their own row; the given id becomes ``source_page_id``.

    Ids may be missing or shared by several pages. The key is the row's place in the
    input. A repeated task gives it again if the input is a scan; after a join or a shuffle it may not, so
    the plans write keyed rows first (:func:`laid_out`).
    """
    return pages.select(
        F.monotonically_increasing_id().alias("page_id"),
        F.col("page_id").alias("source_page_id"),
        *[c for c in pages.columns if c != "page_id"],
    )


def with_source_id(rows: DataFrame) -> DataFrame:
    """The reverse of :func:`with_row_key`."""
    return rows.drop("page_id").withColumnRenamed("source_page_id", "page_id")


__all__ = ["by_page", "content_regions", "extract_content", "gate_content", "laid_out", "with_row_key", "with_source_id"]
