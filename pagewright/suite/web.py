"""Queries over stored pages: tokens, main content, Markdown, page records, links, frontier."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions import markdown as M
from ..functions import text as T
from ..functions import urls as U
from ..operators import content as C
from ..operators import html_tokens as HT
from ..operators import links as L
from ..operators import seen as SN
from ..operators import markdown as MD
from ..operators import rollups as R
from ..plans import crawl as CR
from ..plans import pages as P
from ..session import cut_lineage, work_dir
from ..sources import sinks
from ..sources.tables import read_pages, read_table
from . import duck as D
from .chunks import crawled_at, longs
from .registry import query
from .scalars import EXCLUDE, INCLUDE, PAGES


def pages(spark, d):
    return read_pages(spark, f"{d}/pages.parquet")


# Tokens by the rules, written for DuckDB's engine: a comment, a whole script or style element, a tag whose
# quoted attributes may hold ">", any other "<...>", text up to the next "<", or a "<" alone.
_TOKEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"""|</?[a-z][^>=]*(?:=\s*(?:"[^"]*"|'[^']*'|[^\s"'>=]|)[^>=]*)*>|</?[a-z][^>]*>|<[/!?][^>]*>|[^<]+|<"""
)
_TOKENS = f"""(SELECT page_id, pos - 1 AS pos, toks[pos] AS raw FROM (SELECT page_id, regexp_extract_all(html, {D.q(_TOKEN)}) AS toks,
    unnest(range(1, len(regexp_extract_all(html, {D.q(_TOKEN)})) + 1)) AS pos FROM {PAGES}))"""
_TAG = f"lower({D.ext('raw', HT.TAG_NAME, 1)})"


@query(
    "html_tokens",
    f"""SELECT page_id, pos::BIGINT AS pos, raw, {_TAG} AS tag FROM {_TOKENS}""",
)
def html_tokens(spark, d):
    return HT.tokenize(pages(spark, d)).select("page_id", *longs("pos"), "raw", "tag")


@query("html_tokens_restore", f"SELECT page_id, md5(html) AS digest FROM {PAGES}")
def html_tokens_restore(spark, d):
    """The tokens of a page in order are the page."""
    joined = MD._joined(F.col("raw"), "pos")
    return HT.tokenize(C.by_page(pages(spark, d))).groupBy("page_id").agg(F.md5(joined).alias("digest"))


_NOISE = ", ".join(D.q(t) for t in HT.NOISE_TAGS)


@query(
    "html_without_noise",
    f"""WITH t AS (SELECT page_id, pos, raw, {_TAG} AS tag FROM {_TOKENS}),
        n AS (SELECT *, sum(CASE WHEN tag IN ({_NOISE}) AND raw NOT LIKE '<%</%' THEN CASE WHEN raw LIKE '</%' THEN -1 ELSE 1 END ELSE 0 END)
              OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM t)
        SELECT page_id, count(*) AS tokens, md5(string_agg(raw, '' ORDER BY pos)) AS digest FROM n
        WHERE depth = 0 AND tag NOT IN ({_NOISE}) AND raw NOT LIKE '<!%' GROUP BY page_id""",
)
def html_without_noise(spark, d):
    """What is left of a page without scripts, styles, navigation, headers, footers and asides."""
    kept = HT.without_noise(HT.pair_tags(HT.tokenize(C.by_page(pages(spark, d)))))
    return kept.groupBy("page_id").agg(
        F.count("*").alias("tokens"), F.md5(MD._joined(F.col("raw"), "pos")).alias("digest")
    )


# Independent statement of the pick: on these pages the primary region is the article.
_REGION = f"""(SELECT page_id, url, html, {D.ext('html', '(?is)<article>(.*?)</article>', 1)} AS art,
    {D.ext('html', '(?is)<body>(.*?)(?:</body>|$)', 1)} AS body FROM {PAGES})"""
_TEXTS = f"(SELECT *, {D.strip('art')} AS art_text, {D.strip('body')} AS body_text FROM {_REGION})"
_SCORES = f"""(SELECT *, CASE WHEN length(art_text) >= 500 THEN {D.score('art_text', 'art')} END AS art_score,
    CASE WHEN length(body_text) >= 500 THEN {D.score('body_text', 'body')} END AS body_score FROM {_TEXTS})"""
_PICKED = f"""(SELECT *, CASE WHEN length(art_text) >= 500 THEN 'readability'
    WHEN art_score IS NOT NULL AND art_score >= coalesce(body_score, 0) THEN 'fallback-article' WHEN body_score > 0 THEN 'fallback-body' END AS method FROM {_SCORES})"""
_CONTENT = f"""(SELECT page_id, url, html, method, CASE WHEN method = 'fallback-body' THEN body WHEN method IS NOT NULL THEN art END AS content,
    CASE WHEN method = 'fallback-body' THEN body_text WHEN method IS NOT NULL THEN art_text END AS content_text FROM {_PICKED})"""


@query(
    "main_content",
    f"""SELECT page_id, method, content LIKE '%<nav>%' AS has_nav, length(content) AS content_length, content_text,
        {D.excerpt('content_text')} AS excerpt, coalesce(method LIKE 'fallback%', false) AS fallback_used,
        CASE WHEN method LIKE 'fallback%' THEN ceil(length(content_text) / 1000.0)::BIGINT ELSE length(content_text) END AS read_time FROM {_CONTENT}""",
)
def main_content(spark, d):
    """Primary pick, else the best selector."""
    c = C.extract_content(C.laid_out(pages(spark, d)))
    return c.select(
        "page_id", "method", F.col("content_html").contains("<nav>").alias("has_nav"),
        F.length("content_html").cast("long").alias("content_length"), "content_text", "excerpt",
        "fallback_used", *longs("read_time"),
    )


@query(
    "fallback_content",
    f"""SELECT page_id, CASE WHEN art_score >= coalesce(body_score, 0) THEN 'fallback-article' WHEN body_score > 0 THEN 'fallback-body' END AS method,
        CASE WHEN art_score >= coalesce(body_score, 0) THEN length(art) WHEN body_score > 0 THEN length(body) END AS content_length FROM {_SCORES}""",
)
def fallback_content(spark, d):
    """Best region over all selectors, ties to the first selector."""
    c = C.extract_content(C.laid_out(pages(spark, d)), use_primary=False)
    return c.select("page_id", "method", F.length("content_html").cast("long").alias("content_length"))


# Markdown of these pages: headings, paragraphs, breaks, nothing else that writes.
_PREP = f"(SELECT *, {D.steps('content', M.PRE_STEPS)} AS prepared FROM {_CONTENT})"
_MTOK = f"""(SELECT page_id, pos, toks[pos] AS raw FROM (SELECT page_id, regexp_extract_all(prepared, {D.q(_TOKEN)}) AS toks,
    unnest(range(1, len(regexp_extract_all(prepared, {D.q(_TOKEN)})) + 1)) AS pos FROM {_PREP}))"""
_ESC = D.steps(D.sub(D.decode("raw"), r"[ \t\r\n]+", " "), MD.ESCAPES)
_FRAG = f"""CASE WHEN depth > 0 OR tag IN ('nav', 'footer') OR raw LIKE '<!%' THEN '' WHEN tag = '' THEN {_ESC} WHEN raw = '<h1>' THEN {D.q(chr(10) * 2 + '# ')}
    WHEN tag = 'br' THEN {D.q(MD.BREAK + chr(10))} WHEN tag = 'b' THEN '' ELSE {D.q(chr(10) * 2)} END"""
_DRAWN = f"""(SELECT page_id, string_agg({_FRAG}, '' ORDER BY pos) AS md FROM (SELECT *, sum(CASE WHEN tag IN ('nav', 'footer')
    THEN CASE WHEN raw LIKE '</%' THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth
    FROM (SELECT *, {_TAG} AS tag FROM {_MTOK})) GROUP BY page_id)"""
_SPACED = D.steps(
    "md",
    ((" {2,}", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (MD.BREAK, "  "), (r"^[\t\r\n]+", ""), (r"[\t\r\n ]+$", "")),
)
_MARKDOWN = f"""(SELECT c.page_id, url, html, method, content, {D.steps('md', M.POST_STEPS)} AS markdown
    FROM {_CONTENT} c LEFT JOIN (SELECT page_id, {_SPACED} AS md FROM {_DRAWN}) m ON c.page_id = m.page_id)"""


@query(
    "page_markdown",
    f"""SELECT page_id, coalesce(markdown, '') AS markdown, {D.plain("coalesce(markdown, '')")} AS text_content FROM {_MARKDOWN}""",
)
def page_markdown(spark, d):
    """Main content as Markdown and as plain text."""
    c = C.extract_content(C.laid_out(pages(spark, d)))
    return MD.render_markdown(c).select("page_id", "markdown", "text_content")


_GATED = f"""(SELECT page_id, url, html, method, markdown, length({D.body_text('html')}) AS body_n, {D.plain("coalesce(markdown, '')")} AS plain FROM {_MARKDOWN})"""
_STATUS = f"""(SELECT *, CASE WHEN body_n < 600 THEN 'parsing' WHEN method IS NULL THEN 'extraction' WHEN trim(coalesce(markdown, '')) = '' OR trim(plain) = ''
    OR length(plain) < 600 OR length(plain) > 4000 THEN 'validation' END AS error_stage,
    CASE WHEN body_n < 600 THEN 'HTML parsing failed: Content too short: ' || body_n || ' characters (minimum: 600)'
    WHEN method IS NULL THEN 'Content extraction failed: No suitable content found with any fallback method'
    WHEN trim(coalesce(markdown, '')) = '' THEN 'Final result has no Markdown content' WHEN trim(plain) = '' THEN 'Final result has no text content'
    WHEN length(plain) < 600 THEN 'Final content too short: ' || length(plain) || ' characters'
    WHEN length(plain) > 4000 THEN 'Final content too long: ' || length(plain) || ' characters' END AS error FROM {_GATED})"""


def tight_params():
    """Limits that make some of the test pages fail each gate."""
    return P.PageJobParams(min_content_length=600, max_content_length=4000)


@query(
    "page_gates",
    f"""SELECT page_id, CASE WHEN error IS NULL THEN 'success' ELSE 'extraction_failed' END AS status, error_stage, error FROM {_STATUS}""",
)
def page_gates(spark, d):
    """Status, stage and message of every page under tight limits."""
    return P.page_content(pages(spark, d), tight_params()).select("page_id", "status", "error_stage", "error")


@query(
    "page_failures",
    f"""SELECT url, {D.title('html')} AS title, 'extraction_failed' AS status, error, error_stage FROM {_STATUS} WHERE error IS NOT NULL""",
)
def page_failures(spark, d):
    """Failed page records, written to quarantine and read back."""
    results = P.page_results(pages(spark, d), tight_params(), crawled_at())
    good, bad = work_dir(spark, "page-results"), work_dir(spark, "quarantine")
    sinks.write_results(results, good, bad)
    return spark.read.parquet(bad)


@query("page_results")
def page_results(spark, d):
    """The whole page job: one nested record per page."""
    return P.page_results(pages(spark, d), crawled_at=crawled_at())


@query("page_chunks")
def page_chunks(spark, d):
    """The whole page job as flat, enriched chunk rows."""
    return P.page_chunks(pages(spark, d), crawled_at=crawled_at())


@query(
    "page_record_totals",
    f"""SELECT url, CASE WHEN error IS NULL THEN 'success' ELSE 'extraction_failed' END AS status, method AS extraction_method,
        CASE WHEN error IS NULL THEN {D.sub(D.clean('markdown'), D.WS)} ELSE '' END AS visible, true AS sums_agree FROM {_STATUS.replace('600', '100').replace('4000', '1000000')}""",
)
def page_record_totals(spark, d):
    """Nested records: without overlap the chunks hold the page's text, and the totals are their sums."""
    r = P.page_results(pages(spark, d), P.PageJobParams(chunk_overlap=0), crawled_at())
    content = F.transform("chunks", lambda c: c["content"])
    sums = (
        (F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["tokens"]) == F.col("total_tokens"))
        & (F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["word_count"]) == F.col("total_words"))
        & (F.size("chunks") == F.col("total_chunks"))
    )
    visible = F.regexp_replace(F.array_join(content, ""), D.WS, "")
    return r.select("url", "status", "extraction_method", visible.alias("visible"), sums.alias("sums_agree"))


@query("page_rollup")
def page_rollup(spark, d):
    """Chunks, tokens and words per page."""
    return R.page_rollup(page_chunks(spark, d), ["page_id", "url"])


@query(
    "page_run_statistics",
    f"""SELECT count(*) AS total_requests, count(*) FILTER (error IS NULL) AS successful_requests, 0::BIGINT AS failed_requests,
        count(*) FILTER (error IS NOT NULL) AS failed_extractions, {D.round_to('count(*) FILTER (error IS NULL)::DOUBLE / count(*) * 100', 0)}::BIGINT AS success_rate
        FROM {_STATUS}""",
)
def page_run_statistics(spark, d):
    """Run statistics, taken while the records are written, written as JSON and read back."""
    path = work_dir(spark, "run")
    sinks.write_run(P.page_results(pages(spark, d), tight_params(), crawled_at()), path)
    names = ("total_requests", "successful_requests", "failed_requests", "failed_extractions", "success_rate")
    return spark.read.json(f"{path}/statistics").select(*longs(*names))


@query(
    "page_run_records",
    f"""SELECT url, CASE WHEN error IS NULL THEN 'success' ELSE 'extraction_failed' END AS status, error FROM {_STATUS}""",
)
def page_run_records(spark, d):
    """The records of the same pass, by status."""
    path = work_dir(spark, "run")
    sinks.write_run(P.page_results(pages(spark, d), tight_params(), crawled_at()), path)
    return spark.read.parquet(f"{path}/records").select("url", "status", "error")


@query(
    "page_record_schema",
    f"""SELECT url, CASE WHEN error IS NULL THEN 'success' ELSE 'extraction_failed' END AS status, error IS NULL AS has_chunks, 11::BIGINT AS fields
        FROM {_STATUS.replace('600', '100').replace('4000', '1000000')}""",
)
def page_record_schema(spark, d):
    """The records of the page job, written, and read back by the declared schema."""
    path = work_dir(spark, "page-records")
    page_results(spark, d).write.parquet(path)
    back = spark.read.schema(sinks.PAGE_RESULT_SCHEMA).parquet(path)
    # Chunks carry their text and their metadata as declared.
    whole = F.forall("chunks", lambda c: c["content"].isNotNull() & c["metadata"]["source"]["url"].isNotNull())
    return back.select(
        "url", "status", ((F.size("chunks") > 0) & whole).alias("has_chunks"), F.lit(len(back.columns)).cast("long").alias("fields")
    )


# --- links -----------------------------------------------------------------

_HREF_Q = D.q(L.HREF)
_LINKS = f"""(SELECT page_id AS src_page_id, url AS src_url, pos - 1 AS pos, {D.sub("hrefs[pos]", "^[\"']|[\"']$")} AS href
    FROM (SELECT page_id, url, regexp_extract_all({D.sub('html', L.NOT_LINKS)}, {_HREF_Q}, 1) AS hrefs,
    unnest(range(1, len(regexp_extract_all({D.sub('html', L.NOT_LINKS)}, {_HREF_Q}, 1)) + 1)) AS pos FROM {PAGES}))"""


@query(
    "page_links",
    f"""SELECT src_page_id, src_url, pos::BIGINT AS pos, href, {D.u_norm('absolute')} AS dst_url
        FROM (SELECT *, {D.u_origin('src_url')} || href AS absolute FROM {_LINKS})""",
)
def page_links(spark, d):
    return L.page_links(pages(spark, d)).select("src_page_id", "src_url", *longs("pos"), "href", "dst_url")


@query(
    "visit_once",
    f"""SELECT {D.u_norm('url')} AS url, min(page_id % 4)::BIGINT AS depth FROM (SELECT regexp_replace(url, '[?].*$', '') AS url, page_id FROM pages) GROUP BY 1""",
)
def visit_once(spark, d):
    seen = read_table(spark, d, "pages").select(
        F.regexp_replace("url", "[?].*$", "").alias("url"), (F.col("page_id") % 4).alias("depth")
    )
    return L.visit_once(seen)


@query(
    "unvisited_urls",
    f"SELECT DISTINCT {D.u_norm('url')} AS url FROM pages EXCEPT SELECT {D.u_norm('url')} FROM pages WHERE page_id % 3 = 0",
)
def unvisited_urls(spark, d):
    """Normalised URLs that were not visited before."""
    urls = read_table(spark, d, "pages").select("page_id", U.normalize("url").alias("url"))
    return L.unvisited(urls.select("url").distinct(), urls.where(F.col("page_id") % 3 == 0))


@query(
    "unvisited_urls_filtered",
    f"SELECT DISTINCT {D.u_norm('url')} AS url FROM pages EXCEPT SELECT {D.u_norm('url')} FROM pages WHERE page_id % 3 = 0",
)
def unvisited_urls_filtered(spark, d):
    """As unvisited_urls, with a Bloom filter before the exact check."""
    urls = read_table(spark, d, "pages").select("page_id", U.normalize("url").alias("url"))
    visited = urls.where(F.col("page_id") % 3 == 0).select("url")
    parts = SN.parts_for(urls.count())
    return SN.unseen(urls.select("url").distinct(), visited, SN.build_filter(visited, "url", parts), "url", parts)


@query(
    "glob_join",
    f"SELECT page_id, url FROM pages WHERE {D.globs('url', INCLUDE)} AND NOT {D.globs('url', EXCLUDE)}",
)
def glob_join(spark, d):
    """URLs kept by a table of include globs and not dropped by a table of exclude globs."""
    def table(globs):
        return spark.createDataFrame([(g,) for g in globs], "pattern string")

    urls = read_table(spark, d, "pages").select("page_id", "url")
    kept = L.filter_by_globs(urls, table(INCLUDE))
    return L.filter_by_globs(kept, table(EXCLUDE), keep_matches=False)


# A link graph with depth: page n links to 2n, 2n+1 and n+7, by position among all pages;
# page 0 also links to every fifth page.
def ring_links(spark, d):
    ids = read_table(spark, d, "pages").select(F.col("page_id").alias("i"), U.normalize("url").alias("url"))
    hops = ids.select("i", F.explode(F.array(F.col("i") * 2, F.col("i") * 2 + 1, F.col("i") + 7)).alias("j")).unionByName(
        ids.where(F.col("i") % 5 == 0).select(F.lit(0).cast("long").alias("i"), F.col("i").alias("j"))
    )
    src = ids.select("i", F.col("url").alias("src_url"))
    dst = ids.select(F.col("i").alias("j"), F.col("url").alias("dst_url"))
    return hops.join(src, "i").join(dst, "j").select("src_url", "dst_url")


_IDS = f"(SELECT page_id AS i, {D.u_norm('url')} AS url FROM pages)"
_EDGES = f"""(SELECT DISTINCT s.url AS src_url, t.url AS dst_url FROM (
    SELECT i, unnest([i * 2, i * 2 + 1, i + 7]) AS j FROM {_IDS} UNION ALL SELECT 0, i FROM {_IDS} WHERE i % 5 = 0) h
    JOIN {_IDS} s ON h.i = s.i JOIN {_IDS} t ON h.j = t.i)"""
MAX_DEPTH = 4
_DECISION = D.admission("e.dst_url", "f.depth + 1", MAX_DEPTH, INCLUDE, ("**/*.html",))
# Levels of a breadth-first walk; a URL is decided on the first level that reaches it.
_REACH = f"""WITH RECURSIVE edges AS MATERIALIZED {_EDGES}, walk(url, depth, decision) AS (
    SELECT url, 0, 'allowed' FROM {_IDS} WHERE i IN (0, 3)
    UNION SELECT e.dst_url, f.depth + 1, {_DECISION} FROM walk f JOIN edges e ON e.src_url = f.url
    WHERE f.decision = 'allowed' AND f.depth < {MAX_DEPTH})
    SELECT url, min(depth)::BIGINT AS depth, arg_min(decision, depth) AS decision FROM walk GROUP BY url"""


def frontier(spark, d):
    seeds = read_table(spark, d, "pages").where(F.col("page_id").isin(0, 3)).select("url")
    return L.expand_frontier(seeds, ring_links(spark, d), MAX_DEPTH, INCLUDE, ("**/*.html",))


@query("link_frontier", _REACH)
def link_frontier(spark, d):
    return frontier(spark, d).select("url", *longs("depth"), "decision")


@query("link_frontier_large", _REACH)
def link_frontier_large(spark, d):
    """The frontier as a graph with very many links is walked."""
    seeds = read_table(spark, d, "pages").where(F.col("page_id").isin(0, 3)).select("url")
    reached = L.expand_frontier(seeds, ring_links(spark, d), MAX_DEPTH, INCLUDE, ("**/*.html",), filter_above=0)
    return reached.select("url", *longs("depth"), "decision")


@query("link_frontier_counts", f"SELECT decision, count(*) AS n FROM ({_REACH}) GROUP BY decision")
def link_frontier_counts(spark, d):
    return L.decision_counts(frontier(spark, d))


@query(
    "link_frontier_budget",
    f"SELECT url, depth FROM ({_REACH}) WHERE decision = 'allowed' ORDER BY depth, url LIMIT 20",
)
def link_frontier_budget(spark, d):
    """The first 20 pages to visit, shallow ones first."""
    allowed = frontier(spark, d).where(F.col("decision") == "allowed").select("url", *longs("depth"))
    return L.page_budget(allowed, 20)


@query(
    "link_frontier_filtered",
    f"""SELECT url, depth, decision FROM ({_REACH.replace('JOIN edges e ON', "JOIN edges e ON e.dst_url NOT LIKE '%spam%' AND")})""",
)
def link_frontier_filtered(spark, d):
    """Frontier with a caller's own predicate on links."""
    seeds = read_table(spark, d, "pages").where(F.col("page_id").isin(0, 3)).select("url")
    reached = L.expand_frontier(
        seeds, ring_links(spark, d), MAX_DEPTH, INCLUDE, ("**/*.html",), allow=~F.col("url").contains("spam")
    )
    return reached.select("url", *longs("depth"), "decision")


# A run without a budget, from all pages without a query string.
_RUN = _REACH.replace("WHERE i IN (0, 3)", "WHERE url NOT LIKE '%?%'")


def _run_seeds(spark, d):
    return pages(spark, d).where(~U.normalize("url").contains("?")).select("url")


@query(
    "seeded_run",
    f"""WITH run AS (SELECT url, depth FROM ({_RUN}) WHERE decision = 'allowed')
        SELECT r.url, r.depth, CASE WHEN s.error IS NULL THEN 'success' ELSE 'extraction_failed' END AS status
        FROM run r JOIN (SELECT *, {D.u_norm('url')} AS norm FROM {_STATUS}) s ON s.norm = r.url""",
)
def seeded_run(spark, d):
    """Seeds over links, globs and depth to the state of all pages that are reached."""
    stored = pages(spark, d)
    p = P.PageJobParams(crawl_depth=MAX_DEPTH, include_globs=INCLUDE, max_pages=None, min_content_length=600, max_content_length=4000)
    visited = cut_lineage(CR.visited_urls(_run_seeds(spark, d), stored, p, links=ring_links(spark, d), exclude=("**/*.html",)))
    done = P.page_content(CR.visited_pages(visited, stored), p).select(U.normalize("url").alias("url"), "status")
    return visited.join(done, "url").select("url", *longs("depth"), "status")


@query(
    "seeded_run_records",
    f"""WITH run AS (SELECT url FROM ({_RUN}) WHERE decision = 'allowed')
        SELECT s.url, CASE WHEN error IS NULL THEN 'success' ELSE 'extraction_failed' END AS status, method AS extraction_method,
        md5(CASE WHEN error IS NULL THEN {D.sub(D.clean('markdown'), D.WS)} ELSE '' END) AS text_digest, true AS sums_agree
        FROM run r JOIN (SELECT *, {D.u_norm('url')} AS norm FROM {_STATUS.replace('600', '100').replace('4000', '1000000')}) s ON s.norm = r.url""",
)
def seeded_run_records(spark, d):
    """Seeds to nested page records, all reachable pages: without overlap the chunks of a record hold its text."""
    p = P.PageJobParams(crawl_depth=MAX_DEPTH, include_globs=INCLUDE, max_pages=None, chunk_overlap=0)
    r = CR.crawl(_run_seeds(spark, d), pages(spark, d), p, crawled_at(), links=ring_links(spark, d), exclude=("**/*.html",))
    text = F.regexp_replace(F.array_join(F.transform("chunks", lambda c: c["content"]), ""), D.WS, "")
    sums = (F.col("total_chunks") == F.size("chunks")) & (
        F.col("total_tokens") == F.aggregate("chunks", F.lit(0).cast("long"), lambda acc, c: acc + c["tokens"])
    )
    return r.select("url", "status", "extraction_method", F.md5(text).alias("text_digest"), sums.alias("sums_agree"))


@query(
    "page_chunk_words",
    f"""SELECT page_id, length(markdown) AS markdown_length, {D.words(D.clean('markdown'))} AS words FROM {_STATUS.replace('600', '100').replace('4000', '1000000')} WHERE error IS NULL""",
)
def page_chunk_words(spark, d):
    """Words of the cleaned Markdown per successful page."""
    c = P.page_content(pages(spark, d)).where(F.col("status") == "success")
    return c.select(
        "page_id", F.length("markdown").cast("long").alias("markdown_length"),
        T.word_count(T.clean("markdown")).alias("words"),
    )


