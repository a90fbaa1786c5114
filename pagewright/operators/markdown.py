"""HTML to Markdown: tokens to fragments, fragments to lines, lines with prefixes.

What a token writes depends on the tokens around it. That is found on narrow rows, windows over places, tag
names and counts, and comes back to the page as one array. The text stays in the row of its page, where
tokens and array meet; the same goes for lines and their prefixes. Like the content pick, everything
is partitioned by page id, in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html as H
from ..functions import markdown as M
from ..functions import urls as U
from ..functions.core import NEEDED, is_blank, let, replace_all
from ..session import cut_lineage_in_layout
from .content import BLOCK_TAGS
from .html_tokens import NOISE_TAGS, TOKEN_OR_END, pair_tags, tags_with_text, tokenize_tags

# Control characters stand for structure until the last step; they are not legal in
# HTML text and are removed from it first.
UL, OL, LIST_END, ITEM, QUOTE, QUOTE_END = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06"
LANG, CODE_END = "\x07", "\x08"
NEWLINE, SPACE, TAB, BREAK = "\x0e", "\x0f", "\x10", "\x11"
STRONG, STRONG_END, EM, EM_END = "\x12", "\x13", "\x14", "\x15"
CONTROLS = "[\x01-\x08\x0e-\x1f]"
MARKS = "\x01-\x06"

# Characters escaped in running text, in order.
ESCAPES = (
    (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\$1"),
    (r"^(#{1,6}) ", r"\\$1 "), ("`", r"\\`"), (r"^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"),
    (r"^>", r"\\>"), ("_", r"\\_"), (r"^([0-9]+)\. ", r"$1\\. "),
)
SPECIAL = r"[\\*`\[\]_]|^[-+=#~>0-9]"

STRONG_TAGS, EM_TAGS, STRIKE_TAGS = ("strong", "b"), ("em", "i"), ("del", "s", "strike")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

#: After the fragments are joined: spaces, emphasis edges, blank lines.
JOIN_STEPS = (
    (" {2,}", " "),
    (f"([{STRONG}{EM}]) ", " $1"),
    (f" ([{STRONG_END}{EM_END}])", "$1 "),
    (f"{STRONG}{STRONG_END}|{EM}{EM_END}", ""),
    (" {2,}", " "),
    (r" *\n *", "\n"),
    (rf"(?<![\n{MARKS}])\n{{3,}}(?![\n{MARKS}])", "\n\n"),
    (rf"(?<=[{MARKS}])\n{{4,}}|\n{{4,}}(?=[{MARKS}])", "\n\n\n"),
)
#: The control characters back to text, and the edges.
LAST_STEPS = (
    (CODE_END, ""), (BREAK, "  "), (f"[{STRONG}{STRONG_END}]", "**"), (f"[{EM}{EM_END}]", "*"),
    (f"[{MARKS}]", ""), (r"^[\t\r\n]+", ""), (r"[\t\r\n ]+$", ""),
)
# What texts must contain for these, as for the other patterns.
NEEDED.update({
    JOIN_STEPS[1][0]: (f"{STRONG} ", f"{EM} "), JOIN_STEPS[2][0]: (f" {STRONG_END}", f" {EM_END}"),
    JOIN_STEPS[3][0]: (STRONG + STRONG_END, EM + EM_END), JOIN_STEPS[6][0]: "\n\n\n", JOIN_STEPS[7][0]: "\n\n\n\n",
    CODE_END: CODE_END, BREAK: BREAK, f"[{STRONG}{STRONG_END}]": (STRONG, STRONG_END), f"[{EM}{EM_END}]": (EM, EM_END),
    f"[{MARKS}]": (UL, OL, LIST_END, ITEM, QUOTE, QUOTE_END),
})


def _text(raw: Column, in_pre: Column, in_code: Column) -> Column:
    plain = H.decode_entities(F.regexp_replace(raw, CONTROLS, ""))
    squeezed = replace_all(plain, ((r"[ \t\r\n]+", " "),))
    escaped = let(squeezed, lambda s: F.when(s.rlike(SPECIAL), replace_all(s, ESCAPES)).otherwise(s))
    return (
        F.when(in_pre, F.translate(plain, "\n \t\r", NEWLINE + SPACE + TAB))
        .when(in_code, squeezed)
        .otherwise(escaped)
    )


def _titled(url: Column, title: Column) -> Column:
    return F.concat(
        F.lit("]("), U.with_https(url),
        F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(' "'), title, F.lit('"'))).otherwise(""),
        F.lit(")"),
    )


def _image(raw: Column) -> Column:
    src = H.raw_attribute(raw, "src")
    alt = F.coalesce(H.raw_attribute(raw, "alt"), F.lit(""))
    image = F.concat(F.lit("!["), alt, _titled(src, H.raw_attribute(raw, "title")))
    return F.when(F.coalesce(src, F.lit("")) != "", image).otherwise("")


def _fragment(raw: Column, f: Column, tokens: Column) -> Column:
    """What one token without the text after it contributes, from the flags around it (see :func:`token_flags`)."""
    tag, matched = f["tag"], f["mate"].isNotNull()
    opens, closes, pre = f["kind"] == "open", f["kind"] == "close", f["pre"]

    def both(first: str, second: str) -> Column:
        return F.when(opens, first).otherwise(second)

    fence = F.concat(F.lit("\n\n```"), F.when(f["code_next"], LANG).otherwise(""), F.lit("\n"))
    border = F.when(f["border"] > 0, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), f["border"]))).otherwise("")
    heading_open = F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" "))
    opener = F.element_at(tokens, f["mate"] + 1)
    # What an image or the end of a link writes, references resolved.
    target = H.decode_entities(_titled(H.raw_attribute(opener, "href"), H.raw_attribute(opener, "title")))
    box = F.when(H.raw_attribute(raw, "type") == "checkbox", F.when(raw.rlike(r"(?i)\schecked\b"), "[x] ").otherwise("[ ] ")).otherwise("")
    return (
        F.when(f["kind"] == "text", _text(raw, pre, f["code"]))
        .when(tag == "br", F.when(pre, NEWLINE).otherwise(BREAK + "\n"))
        .when(tag == "hr", "\n\n---\n\n")
        .when(tag == "img", H.decode_entities(_image(raw)))
        .when(tag == "input", box)
        .when((tag == "pre") & matched & opens, fence)
        .when((tag == "pre") & matched & closes, f"{CODE_END}\n```\n\n")
        .when((tag == "code") & matched, F.when(pre, "").otherwise("`"))
        .when((tag == "a") & matched & f["linked"], F.when(opens, "[").otherwise(target))
        .when(tag.isin(*STRONG_TAGS) & matched & ~pre, both(STRONG, STRONG_END))
        .when(tag.isin(*EM_TAGS) & matched & ~pre, both(EM, EM_END))
        .when(tag.isin(*STRIKE_TAGS) & matched & ~pre, "~")
        .when(tag.isin(*HEADINGS), F.when(opens, heading_open).otherwise("\n\n"))
        .when((tag == "ul") & matched, both(f"\n{UL}\n", f"\n{LIST_END}\n"))
        .when((tag == "ol") & matched, both(f"\n{OL}\n", f"\n{LIST_END}\n"))
        .when(tag == "li", both(f"\n{ITEM}\n", "\n"))
        .when((tag == "blockquote") & matched, both(f"\n{QUOTE}\n", f"\n{QUOTE_END}\n"))
        .when(tag == "tr", F.when(opens, "\n|").otherwise(border))
        .when(tag.isin("td", "th"), both(" ", " |"))
        .when(tag.isin("thead", "tbody", "tfoot"), "")
        .when(tag.isin(*BLOCK_TAGS), "\n\n")
        .otherwise("")
    )


def _joined(value: Column, *order: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*order, value.alias("s"))))
    return F.array_join(F.transform(ordered, lambda x: x["s"]), "")


def token_flags(pages: DataFrame, html: str) -> DataFrame:
    """(page_id, flags): what stands around each tag of a page and the text after it, in the order of ``tags_with_text``.

    Flags are tag, kind, mate (place of the other tag of a pair), visible and heard (tag and text outside removed
    elements), pre and code (inside such), code_next, linked (of a link with an address) and border (cells of the heading row that
    ends here). No text goes through the windows.
    """
    tag, raw, opens = F.col("tag"), F.col("raw"), F.col("kind") == "open"
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    cell = opens & tag.isin("td", "th")
    linked = opens & (tag == "a") & (F.coalesce(H.raw_attribute(raw, "href"), F.lit("")) != "")
    narrow = tokenize_tags(pages, html).select(
        "page_id", "pos", "tag", "kind", linked.alias("linked"), (F.col("text") == "").alias("bare")
    ).select(
        "*",
        F.sum(cell.cast("int")).over(w).alias("cells"),
        F.sum((opens & (tag == "td")).cast("int")).over(w).alias("tds"),
        F.sum((opens & (tag == "tr")).cast("int")).over(w).alias("rows"),
    )
    paired = pair_tags(narrow, ["linked", "cells", "tds"])
    matched = F.col("mate").isNotNull()
    step = F.when(opens, 1).when(F.col("kind") == "close", -1).otherwise(0)

    def depth(*tags: str) -> Column:
        return F.sum(F.when(tag.isin(*tags) & matched, step).otherwise(0)).over(w)

    flagged = paired.select(
        "*",
        depth(*NOISE_TAGS).alias("noise"),
        (depth("pre") > 0).alias("pre"),
        (depth("code") > 0).alias("code"),
        (depth("thead") > 0).alias("in_head"),
        F.last(F.when(opens & (tag == "table"), F.col("rows")), ignorenulls=True).over(w).alias("rows_before"),
        F.coalesce(
            F.col("bare") & (F.lead("tag").over(W.partitionBy("page_id").orderBy("pos")) == "code"), F.lit(False)
        ).alias("code_next"),
    )
    removed_close = tag.isin(*NOISE_TAGS) & (F.col("kind") == "close")
    visible = (F.col("noise") == 0) & ~removed_close & ~F.col("kind").isin("raw", "comment")
    first_row = F.col("rows") - F.col("rows_before") == 1
    heading = F.col("in_head") | (first_row & (F.col("tds") == F.col("mate_tds")))
    ends_heading = (tag == "tr") & (F.col("kind") == "close") & matched & heading
    border = F.when(ends_heading, F.col("cells") - F.col("mate_cells")).otherwise(0).cast("int")
    is_link = F.col("linked") | F.coalesce("mate_linked", F.lit(False))
    flags = F.struct(
        "pos", "tag", "kind", F.col("mate").cast("int").alias("mate"), visible.alias("visible"),
        (F.col("noise") == 0).alias("heard"), "pre", "code", "code_next",
        is_link.alias("linked"), border.alias("border"),
    )
    return flagged.groupBy("page_id").agg(F.array_sort(F.collect_list(flags)).alias("flags"))


def line_prefixes(pages: DataFrame) -> DataFrame:
    """(page_id, pieces): what is written for the lines of the ``md`` of pages with lists or quotes, in order.

    A piece has a prefix, and with ``text`` the line of that number and its end follow. Each line of a list is renumbered;
    each line of a quote gets ``>``. Only kinds and numbers of lines go through the windows.
    """
    md, line = F.col("md"), F.col("line")
    lines = pages.where(md.rlike(f"[{MARKS}]")).select("page_id", F.posexplode(F.split(md, "\n")).alias("ln", "line"))
    role = (
        F.when(line.isin(UL, OL, QUOTE), "open").when(line.isin(LIST_END, QUOTE_END), "close")
        .when(line == ITEM, "item").otherwise("text")
    )
    w = W.partitionBy("page_id").orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("role") == "open", 1).when(F.col("role") == "close", -1).otherwise(0)
    depth = F.sum(step).over(w)
    narrow = lines.select(
        "page_id", "ln", role.alias("role"), F.when(role == "open", line).alias("mark"), is_blank("line").alias("blank")
    )
    leveled = narrow.withColumn(
        "depth", F.when(F.col("role") == "close", depth + 1).otherwise(depth).cast("int")
    )
    on_level = W.partitionBy("page_id", "depth").orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    innermost = F.last("mark", ignorenulls=True).over(on_level)
    is_text = F.col("role") == "text"
    dropped = is_text & (F.col("depth") > 0) & F.col("blank") & F.col("inner").isin(UL, OL)
    kept = leveled.withColumn("inner", innermost).where(~F.coalesce(dropped, F.lit(False)))
    levels = F.when(is_text & (F.col("depth") > 0), F.sequence(F.lit(1), F.greatest("depth", F.lit(1)))).otherwise(
        F.array("depth")
    )
    rows = kept.select(
        "page_id", "ln", "mark", "blank", "role", "depth", F.explode_outer(levels).alias("lv")
    ).where(F.col("lv").isNotNull())
    at = W.partitionBy("page_id", "lv").orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    opened = F.when(F.col("role") == "open", F.struct("ln", "mark"))
    rows = rows.withColumn("list", F.last(opened, ignorenulls=True).over(at))
    inside = W.partitionBy("page_id", "lv", F.col("list.ln")).orderBy("ln")
    rows = rows.select(
        "*",
        F.sum(is_text.cast("int")).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("n"),
        F.lag("role").over(inside).isin("item", "open").alias("first"),
    )
    indent = F.when(F.coalesce("first", F.lit(False)), "").otherwise("    ")
    kind = F.col("list.mark")
    prefix = (
        F.when(F.col("lv") == 0, "")
        .when(kind == UL, F.concat(F.lit("- "), indent))
        .when(kind == OL, F.concat(F.col("n").cast("string"), F.lit(". "), indent))
        .when(F.col("blank") & (F.col("lv") == F.col("depth")), ">")
        .otherwise("> ")
    )
    written = F.when(is_text, prefix).when((F.col("role") == "close") & (F.col("lv") == 1), "\n").otherwise("")
    piece = F.struct("ln", "lv", written.alias("prefix"), (is_text & (F.col("lv") == F.col("depth"))).alias("text"))
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def _with_prefixes(md: Column, lines: Column, pieces: Column) -> Column:
    """The text again, as the pieces say; text without lists and quotes has none."""
    one = F.transform(pieces, lambda p: F.concat(p["prefix"], F.when(p["text"], F.concat(F.element_at(lines, p["ln"] + 1), F.lit("\n"))).otherwise("")))
    return F.when(md.rlike(f"[{MARKS}]"), F.coalesce(F.array_join(one, ""), F.lit(""))).otherwise(F.concat(md, F.lit("\n")))


def _finish(md: Column) -> Column:
    """Code languages, then the control characters back to text."""
    def plain(m: Column) -> Column:
        drawn = m.contains(NEWLINE) | m.contains(SPACE) | m.contains(TAB)
        return F.when(drawn, F.translate(m, NEWLINE + SPACE + TAB, "\n \t")).otherwise(m)

    md = let(replace_all(md, ((r"\n{3,}", "\n\n"),)), plain)

    def with_language(part: Column, i: Column) -> Column:
        code = F.substring_index(part, CODE_END, 1)
        return F.when(i == 0, part).otherwise(F.concat(M.code_language(F.lit(""), code), part))

    md = let(md, lambda m: F.when(
        m.contains(LANG), F.array_join(F.transform(F.split(m, LANG), with_language), "")
    ).otherwise(m))
    return replace_all(md, LAST_STEPS)


def render_markdown(content: DataFrame, html: str = "content_html", preserve_code: bool = False) -> DataFrame:
    """Add markdown, text_content, conversion_stats and warnings to rows keyed by page_id.

    Emphasis, links, code, lists and quotes count only with both tags present; an
    open tag without its close tag is ignored.
    """
    keep = [c for c in content.columns if c != "page_id"]
    # Both are read twice: for what stands around, and for the text.
    prepared = cut_lineage_in_layout(content.withColumn("_prepared", M.preprocess_html(html, preserve_code)))
    flags = token_flags(prepared.select("page_id", "_prepared"), "_prepared").hint("shuffle_hash")
    tokens = F.regexp_extract_all("_prepared", F.lit(TOKEN_OR_END), F.lit(0))
    drawn = prepared.join(flags, "page_id", "left").withColumn("_tokens", tokens)

    def drawn_tag(e: Column, f: Column) -> Column:
        tag = F.when(f["visible"], _fragment(e["raw"], f, F.col("_tokens"))).otherwise("")
        return F.concat(tag, F.when(f["heard"] & (e["text"] != ""), _text(e["text"], f["pre"], f["code"])).otherwise(""))

    written = F.zip_with(tags_with_text(F.col("_tokens")), "flags", drawn_tag)
    joined = replace_all(F.coalesce(F.array_join(written, ""), F.lit("")), JOIN_STEPS)
    joined = cut_lineage_in_layout(drawn.select("page_id", *keep, "_prepared", joined.alias("md")))
    pieces = line_prefixes(joined.select("page_id", "md")).hint("shuffle_hash")
    lined = joined.join(pieces, "page_id", "left").withColumn("_lines", F.split("md", "\n"))
    laid = lined.withColumn("_laid", _with_prefixes(F.col("md"), F.col("_lines"), F.col("pieces")))
    raw = laid.withColumn("_raw", _finish(F.col("_laid")))
    done = raw.withColumn("markdown", M.postprocess("_raw")).withColumn(
        "text_content", M.to_plain_text("markdown")
    )
    source = F.coalesce(F.col(html), F.lit(""))
    return done.select(
        "page_id", *keep, "markdown", "text_content",
        M.conversion_stats(source, F.col("markdown"), F.col("text_content")).alias("conversion_stats"),
        M.conversion_warnings(
            F.coalesce("_prepared", F.lit("")), F.col("_raw"), F.col("markdown")
        ).alias("warnings"),
    )
