"""Queries over the column functions: URLs, HTML, Markdown text, chunk text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markdown as M
from ..functions import text as T
from ..functions import urls as U
from ..functions.core import is_blank, replace_all
from ..session import spread
from ..sources.tables import read_pages, read_table, seed_urls
from . import duck as D
from .registry import query

PAGES = "(SELECT * FROM pages WHERE length(html) >= 100)"

#: Turns the plain prose of ``documents`` into Markdown with headings, links,
#: code spans, lists, fences, quotes, tables and images.
MD_STEPS = (
    (r"\n", "\n\n# "),
    (r"([a-z]+), ", "[$1](/$1), "),
    (r" (the|le|que|und) ", " `$1` "),
    (r"\. ([A-Z])", ".\n- $1"),
    (r" (and|la|der) ", " **$1** "),
    (r" (of|un) ([a-z]+) ", " $1\n```\n$2 "),
    (r" (by|ou) ([a-z]+) ", " ![$1]($2) "),
    (r" (is|tre) ([a-z]+) ", "\n> $1 $2\n1. "),
    (r" (to|ai) ([a-z]+) ", "\n| $1 | $2 |\n"),
)


def markdown_docs(spark, d):
    """``documents`` as Markdown: doc_id, url, title, markdown."""
    return spread(read_table(spark, d, "documents").select("doc_id", "text", "source")).select(
        "doc_id",
        F.concat(F.lit("https://docs.example.com/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("## "), replace_all("text", MD_STEPS)).alias("markdown"),
    )


MD_DOCS = (
    "(SELECT doc_id, 'https://docs.example.com/' || source || '/' || doc_id AS url, 'Document ' || doc_id AS title, "
    f"'## ' || {D.steps('text', MD_STEPS)} AS markdown FROM documents)"
)


# --- sources ---------------------------------------------------------------


@query(
    "page_scan",
    "SELECT page_id, url, length(html) AS html_length FROM pages WHERE length(html) >= 100",
)
def page_scan(spark, d):
    return read_pages(spark, f"{d}/pages.parquet", min_length=100).select(
        "page_id", "url", F.length("html").cast("long").alias("html_length")
    )


@query(
    "seed_scan",
    f"""SELECT s AS url, {D.u_valid('s')} AS valid FROM (
        SELECT CASE WHEN page_id % 3 = 2 THEN 'ftp:' || url ELSE url END AS s FROM pages)""",
)
def seed_scan(spark, d):
    """Seeds as plain strings, as ``{url}`` objects, and as bad URLs."""
    url = F.col("url")
    seed = (
        F.when(F.col("page_id") % 3 == 0, url)
        .when(F.col("page_id") % 3 == 1, F.to_json(F.struct(url)))
        .otherwise(F.concat(F.lit("ftp:"), url))
    )
    return seed_urls(read_table(spark, d, "pages").select(seed.alias("seed")))


# --- URLs ------------------------------------------------------------------


@query(
    "url_parts",
    f"""SELECT page_id, {D.u_valid('url')} AS valid, {D.u_host('url')} AS host, {D.u_scheme('url')} AS scheme,
        {D.u_path('url')} AS path, {D.u_depth('url')} AS depth, {D.u_origin('url')} AS origin
        FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'not a url ' || page_id ELSE url END AS url FROM pages)""",
)
def url_parts(spark, d):
    url = F.when(
        F.col("page_id") % 10 == 0, F.concat(F.lit("not a url "), F.col("page_id").cast("string"))
    ).otherwise(F.col("url"))
    return read_table(spark, d, "pages").select("page_id", url.alias("url")).select(
        "page_id",
        U.is_http_url("url").alias("valid"),
        U.host("url").alias("host"),
        U.scheme("url").alias("scheme"),
        U.path("url").alias("path"),
        U.path_depth("url").alias("depth"),
        U.origin("url").alias("origin"),
    )


@query(
    "url_normalize",
    f"""SELECT page_id, {D.u_norm('u')} AS norm_url, {D.u_drop(D.u_norm('u'))} AS dedup_url FROM (
        SELECT page_id, regexp_replace(regexp_replace(url, '^https://', 'HTTPS://'), '\\.net/', '.NET:443/') AS u FROM pages)""",
)
def url_normalize(spark, d):
    messy = F.regexp_replace(
        F.regexp_replace("url", "^https://", "HTTPS://"), r"\.net/", ".NET:443/"
    )
    return read_table(spark, d, "pages").select("page_id", messy.alias("u")).select(
        "page_id",
        U.normalize("u").alias("norm_url"),
        U.drop_params(U.normalize("u")).alias("dedup_url"),
    )


INCLUDE = ("https://**", "http://www.*/en/**", "http://{blog,m}.**")
EXCLUDE = (*U.EXCLUDED_GLOBS, "**/*.html", "**/{es,fr}/[1-4]*")


@query(
    "url_globs",
    f"SELECT page_id, {D.globs('url', INCLUDE)} AS included, {D.globs('url', EXCLUDE)} AS excluded FROM pages",
)
def url_globs(spark, d):
    return read_table(spark, d, "pages").select(
        "page_id",
        U.matches_any_glob("url", INCLUDE).alias("included"),
        U.matches_any_glob("url", EXCLUDE).alias("excluded"),
    )


@query(
    "url_admission",
    f"SELECT page_id, {D.admission('url', 'page_id % 5', 3, INCLUDE, EXCLUDE)} AS decision FROM pages",
)
def url_admission(spark, d):
    return read_table(spark, d, "pages").select(
        "page_id", U.admission("url", F.col("page_id") % 5, 3, INCLUDE, EXCLUDE).alias("decision")
    )


@query(
    "url_admission_counts",
    f"""SELECT decision, count(*) AS n FROM (
        SELECT {D.admission('url', 'page_id % 5', 3, INCLUDE, EXCLUDE)} AS decision FROM pages) GROUP BY decision""",
)
def url_admission_counts(spark, d):
    return url_admission(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@query("url_origins", f"SELECT DISTINCT {D.u_origin('url')} AS origin FROM pages")
def url_origins(spark, d):
    return read_table(spark, d, "pages").select(U.origin("url").alias("origin")).distinct()


@query(
    "url_protocol_relative",
    """SELECT page_id, CASE WHEN h LIKE '//%' THEN 'https:' || h ELSE h END AS link FROM (
        SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?:', '') ELSE url END AS h FROM pages)""",
)
def url_protocol_relative(spark, d):
    h = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?:", "")).otherwise(F.col("url"))
    return read_table(spark, d, "pages").select("page_id", U.with_https(h).alias("link"))


# --- HTML ------------------------------------------------------------------


@query(
    "html_validity",
    f"""SELECT page_id, length(trim(h)) > 0 AS valid, length(h) AS length, {D.has('h', H.HAS_DOCTYPE)} AS has_doctype,
        {D.has('h', H.HAS_HTML)} AS has_html, {D.has('h', H.HAS_HEAD)} AS has_head, {D.has('h', H.HAS_BODY)} AS has_body,
        CASE WHEN trim(h) = '' THEN '' ELSE {D.case_join(
            (f"NOT {D.has('h', H.HAS_BODY)}", "'HTML content missing <body> tag'"),
            (f"NOT {D.has('h', H.HAS_HEAD)}", "'HTML content missing <head> tag'"))} END AS warnings
        FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '  ' WHEN page_id % 7 = 1 THEN substr(html, 40)
              WHEN page_id % 7 = 2 THEN replace(html, '<body>', '') ELSE html END AS h FROM pages)""",
)
def html_validity(spark, d):
    k = F.col("page_id") % 7
    html = (
        F.when(k == 0, "  ")
        .when(k == 1, F.expr("substr(html, 40)"))
        .when(k == 2, F.replace("html", F.lit("<body>"), F.lit("")))
        .otherwise(F.col("html"))
    )
    v = H.validity("h")
    return read_table(spark, d, "pages").select("page_id", html.alias("h")).select(
        "page_id", *[v[c].alias(c) for c in ("valid", "length", "has_doctype", "has_html", "has_head", "has_body")],
        F.array_join(v["warnings"], "; ").alias("warnings"),
    )


@query(
    "html_page_stats",
    f"""SELECT page_id, length(html) AS html_length, {D.title('html')} AS title,
        {D.cnt(D.sub(D.sub('html', H.COMMENT), H.RAW_BODY, '$1$2'), H.OPEN_TAG)} AS element_count,
        length({D.body_text('html')}) AS text_length FROM {PAGES}""",
)
def html_page_stats(spark, d):
    s = H.stats("html")
    return read_pages(spark, f"{d}/pages.parquet").select(
        "page_id", *[s[c].alias(c) for c in ("html_length", "title", "element_count", "text_length")]
    )


@query("html_strip", f"SELECT page_id, {D.strip('html')} AS text FROM {PAGES}")
def html_strip(spark, d):
    return read_pages(spark, f"{d}/pages.parquet").select("page_id", H.strip_to_text("html").alias("text"))


@query(
    "html_content_score",
    f"SELECT page_id, {D.score('t', 'html')} AS score FROM (SELECT page_id, html, {D.strip('html')} AS t FROM {PAGES})",
)
def html_content_score(spark, d):
    return (
        read_pages(spark, f"{d}/pages.parquet")
        .select("page_id", "html", H.strip_to_text("html").alias("t"))
        .select("page_id", H.content_score(F.col("t"), F.col("html")).alias("score"))
    )


@query(
    "html_excerpt",
    f"""SELECT page_id, {D.excerpt('t')} AS excerpt, length(t) AS read_time,
        ceil(length(t) / 1000.0)::BIGINT AS read_time_fallback FROM (SELECT page_id, {D.strip('html')} AS t FROM {PAGES})""",
)
def html_excerpt(spark, d):
    n = F.length("t")
    return (
        read_pages(spark, f"{d}/pages.parquet")
        .select("page_id", H.strip_to_text("html").alias("t"))
        .select(
            "page_id",
            H.excerpt("t").alias("excerpt"),
            H.read_time(n, F.lit(False)).alias("read_time"),
            H.read_time(n, F.lit(True)).alias("read_time_fallback"),
        )
    )


@query(
    "document_excerpt",
    f"SELECT doc_id, {D.excerpt('text')} AS excerpt FROM documents",
)
def document_excerpt(spark, d):
    return read_table(spark, d, "documents").select("doc_id", H.excerpt("text").alias("excerpt"))


@query(
    "html_title",
    f"""SELECT page_id, CASE WHEN t <> '' THEN t WHEN h <> '' THEN h ELSE 'Unknown' END AS title FROM (
        SELECT page_id, {D.title('x')} AS t, {D.u_host('u')} AS h FROM (
            SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(html, '<title>', '<nope>') ELSE html END AS x,
            CASE WHEN page_id % 8 = 0 THEN 'about:blank' ELSE url END AS u FROM {PAGES}))""",
)
def html_title(spark, d):
    x = F.when(F.col("page_id") % 4 == 0, F.replace("html", F.lit("<title>"), F.lit("<nope>"))).otherwise(F.col("html"))
    u = F.when(F.col("page_id") % 8 == 0, "about:blank").otherwise(F.col("url"))
    return (
        read_pages(spark, f"{d}/pages.parquet")
        .select("page_id", x.alias("x"), u.alias("u"))
        .select("page_id", H.page_title("x", "u").alias("title"))
    )


@query(
    "html_byline_description",
    """SELECT page_id, split_part(url, '/', 3) AS byline, 'About "' || page_id || '" & more' AS description FROM pages""",
)
def html_byline_description(spark, d):
    """Author and description from meta tags, which the query writes into the pages first."""
    meta = F.concat(
        F.lit('<head><meta name="author" content="'), F.split("url", "/")[2],
        F.lit("\"/><meta content='About &quot;"), F.col("page_id").cast("string"),
        F.lit("&quot; &amp; more' name='description'>"),
    )
    return (
        read_table(spark, d, "pages")
        .select("page_id", F.replace("html", F.lit("<head>"), meta).alias("h"))
        .select(
            "page_id",
            H.meta_content("h", "author").alias("byline"),
            H.meta_content("h", "description").alias("description"),
        )
    )


@query("html_entities", f"SELECT page_id, {D.decode('html')} AS decoded FROM pages")
def html_entities(spark, d):
    return read_table(spark, d, "pages").select("page_id", H.decode_entities("html").alias("decoded"))


# --- Markdown text ---------------------------------------------------------


@query("markdown_preclean", f"SELECT page_id, {D.steps('html', M.PRE_STEPS)} AS prepared FROM {PAGES}")
def markdown_preclean(spark, d):
    return read_pages(spark, f"{d}/pages.parquet").select("page_id", M.preprocess_html("html").alias("prepared"))


@query(
    "markdown_postclean",
    f"SELECT doc_id, {D.steps('markdown', M.POST_STEPS)} AS markdown FROM {MD_DOCS}",
)
def markdown_postclean(spark, d):
    return markdown_docs(spark, d).select("doc_id", M.postprocess("markdown").alias("markdown"))


@query("markdown_plain_text", f"SELECT doc_id, {D.plain('markdown')} AS text FROM {MD_DOCS}")
def markdown_plain_text(spark, d):
    return markdown_docs(spark, d).select("doc_id", M.to_plain_text("markdown").alias("text"))


@query(
    "markdown_stats",
    f"""SELECT doc_id, length(html) AS html_length, length(markdown) AS markdown_length, length(t) AS text_length,
        length(markdown)::DOUBLE / length(html)::DOUBLE AS compression_ratio, {D.cnt('markdown', M.FENCE)} / 2.0::DOUBLE AS code_blocks,
        {D.cnt('markdown', M.HEADING)} AS headings, {D.cnt('markdown', M.LINK)} AS links, {D.cnt('markdown', M.IMAGE)} AS images,
        {D.cnt('markdown', M.LIST_ITEM)} AS lists, {D.cnt('markdown', M.TABLE_ROW)} AS tables
        FROM (SELECT doc_id, '<p>' || markdown AS html, markdown, {D.plain('markdown')} AS t FROM {MD_DOCS})""",
)
def markdown_stats(spark, d):
    s = M.conversion_stats(F.concat(F.lit("<p>"), "markdown"), F.col("markdown"), F.col("t"))
    names = (
        "html_length", "markdown_length", "text_length", "compression_ratio", "code_blocks",
        "headings", "links", "images", "lists", "tables",
    )
    return (
        markdown_docs(spark, d)
        .select("doc_id", "markdown", M.to_plain_text("markdown").alias("t"))
        .select("doc_id", *[s[n].alias(n) for n in names])
    )


@query(
    "markdown_warnings",
    f"""SELECT page_id, {D.case_join(
        ("contains(p, '<table') AND NOT contains(p, '<th')", "'Table found without header cells - may not convert properly'"),
        (D.cnt('p', '(?i)<code[^>]*>') + ' > 10', "'Many code blocks detected - verify formatting in output'"),
        ("length(md) < length(p) * 0.5", "'Significant content loss during post-processing'"))} AS warnings
        FROM (SELECT page_id, replace(replace(html, '<ul>', '<table>'), '<li>', '<code>') AS p, substr(html, 1, page_id * 20) AS md
              FROM pages)""",
)
def markdown_warnings(spark, d):
    p = F.replace(F.replace("html", F.lit("<ul>"), F.lit("<table>")), F.lit("<li>"), F.lit("<code>"))
    return (
        read_table(spark, d, "pages")
        .select("page_id", p.alias("p"), F.expr("substr(html, 1, int(page_id * 20))").alias("md"))
        .select(
            "page_id",
            F.array_join(M.conversion_warnings(F.col("p"), F.col("p"), F.col("md")), "; ").alias("warnings"),
        )
    )


LANG_HINT = ("def f(): ", "x => y ", "<?php ", "")
CLASS_FORM = ("language-Rust x", "lang-go", "highlight-SQL", "toml-code big", "plain", "two words", "")


def _pick(values, n):
    return f"[{', '.join(D.q(v) for v in values)}][({n}) % {len(values)} + 1]"


def _sql_language(cls, body):
    whens = " ".join(
        f"WHEN {D.has(cls, rx)} THEN lower({D.ext(cls, rx, 1)})" for rx in M.LANGUAGE_CLASSES
    )
    return (
        f"CASE {whens} WHEN contains({body}, 'function ') OR contains({body}, 'const ') OR contains({body}, '=>') THEN 'javascript' "
        f"WHEN contains({body}, 'def ') OR contains({body}, 'import ') THEN 'python' WHEN contains({body}, '<?php') THEN 'php' ELSE '' END"
    )


@query(
    "code_language",
    f"""SELECT doc_id, {_sql_language('cls', 'body')} AS language FROM (
        SELECT doc_id, {_pick(CLASS_FORM, 'doc_id')} AS cls, {_pick(LANG_HINT, 'doc_id // 7')} || text AS body FROM documents)""",
)
def code_language(spark, d):
    def pick(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))

    doc = F.col("doc_id")
    return (
        read_table(spark, d, "documents")
        .select(
            "doc_id",
            pick(CLASS_FORM, doc).alias("cls"),
            F.concat(pick(LANG_HINT, F.floor(doc / 7)), F.col("text")).alias("body"),
        )
        .select("doc_id", M.code_language("cls", "body").alias("language"))
    )


# --- chunk text ------------------------------------------------------------


@query("text_clean", f"SELECT doc_id, {D.clean('markdown')} AS text FROM {MD_DOCS}")
def text_clean(spark, d):
    return markdown_docs(spark, d).select("doc_id", T.clean("markdown").alias("text"))


@query(
    "text_clean_warnings",
    f"""SELECT doc_id, {D.case_join(
        ("length(c) < length(markdown) * 0.8", "'Significant text reduction during preprocessing'"),
        (f"{D.cnt('c', M.FENCE)} / 2.0 > 10",
         f"'Many code blocks detected (' || CASE WHEN {D.cnt('c', M.FENCE)} % 2 = 0 THEN ({D.cnt('c', M.FENCE)} // 2)::VARCHAR "
         f"ELSE ({D.cnt('c', M.FENCE)} / 2.0::DOUBLE)::VARCHAR END || ') - chunking may split code'"))} AS warnings
        FROM (SELECT doc_id, markdown, {D.clean('markdown')} AS c FROM (
            SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(markdown, ' ', '     ') ELSE markdown END AS markdown FROM {MD_DOCS}))""",
)
def text_clean_warnings(spark, d):
    wide = F.when(F.col("doc_id") % 5 == 0, F.replace("markdown", F.lit(" "), F.lit("     "))).otherwise(F.col("markdown"))
    return (
        markdown_docs(spark, d)
        .select("doc_id", wide.alias("m"))
        .select("doc_id", "m", T.clean("m").alias("c"))
        .select("doc_id", F.array_join(T.clean_warnings(F.col("m"), F.col("c")), "; ").alias("warnings"))
    )


@query(
    "text_counts",
    f"""SELECT doc_id, length(markdown) AS length, {D.words('markdown')} AS word_count,
        len(str_split(markdown, chr(10))) AS line_count,
        len(list_filter(str_split(markdown, chr(10) || chr(10)), lambda p: {D.has('p', D.NON_WS)})) AS paragraph_count
        FROM {MD_DOCS}""",
)
def text_counts(spark, d):
    return markdown_docs(spark, d).select(
        "doc_id",
        F.length("markdown").cast("long").alias("length"),
        T.word_count("markdown").alias("word_count"),
        T.line_count("markdown").alias("line_count"),
        T.paragraph_count("markdown").alias("paragraph_count"),
    )


@query("word_count", f"SELECT doc_id, {D.words('text')} AS word_count FROM documents")
def word_count(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.word_count("text").alias("word_count"))


_N = D.struct_counts("markdown")


@query(
    "text_structure",
    f"""SELECT doc_id, {', '.join(f'{_N[k]} AS {k}' for k in _N if k != 'fences')},
        {_N['fences']} / 2.0::DOUBLE AS code_blocks, {D.content_type('markdown')} AS content_type FROM {MD_DOCS}""",
)
def text_structure(spark, d):
    flat = {f"h{i}": f"s.headings.h{i}" for i in range(1, 7)} | {
        "headings": "s.headings.total", "unordered": "s.lists.unordered", "ordered": "s.lists.ordered",
    }
    same = ("code_blocks", "inline_code", "links", "images", "tables", "blockquotes")
    return (
        markdown_docs(spark, d)
        .select("doc_id", T.structure("markdown").alias("s"))
        .select(
            "doc_id",
            *[F.col(v).alias(k) for k, v in flat.items()],
            *[F.col(f"s.{k}").alias(k) for k in same],
            T.content_type(F.col("s")).alias("content_type"),
        )
    )


@query(
    "text_readability",
    f"""SELECT doc_id, {D.round_to(D.div('w', 's'), 1)} AS words_per_sentence, {D.round_to(D.div('c', 'w'), 1)} AS characters_per_word,
        ceil(w / 200.0)::BIGINT AS reading_minutes FROM (SELECT doc_id, {D.words('markdown')} AS w, {D.sentences('markdown')} AS s,
        length({D.sub('markdown', D.WS)}) AS c FROM {MD_DOCS})""",
)
def text_readability(spark, d):
    r = T.readability("markdown")
    return markdown_docs(spark, d).select(
        "doc_id", *[r[c].alias(c) for c in ("words_per_sentence", "characters_per_word", "reading_minutes")]
    )


@query(
    "chunk_ids",
    f"""SELECT doc_id, 'chunk_' || {D.hash36('url')} || '_0_' || {D.hash36('substr(markdown, 1, 100)')} AS chunk_id
        FROM {MD_DOCS}""",
)
def chunk_ids(spark, d):
    return markdown_docs(spark, d).select("doc_id", T.chunk_id("url", F.lit(0), "markdown").alias("chunk_id"))


@query(
    "chunk_keys",
    f"SELECT doc_id, md5(length(url) || ':' || url || ':0:' || markdown) AS chunk_key FROM {MD_DOCS}",
)
def chunk_keys(spark, d):
    """Keys that whole corpora can be joined by."""
    return markdown_docs(spark, d).select("doc_id", T.chunk_key("url", F.lit(0), "markdown").alias("chunk_key"))


@query(
    "text_preview",
    "SELECT doc_id, substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS preview FROM documents",
)
def text_preview(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


@query("blank_documents", "SELECT count(*) AS n FROM documents WHERE trim(text) = ''")
def blank_documents(spark, d):
    return read_table(spark, d, "documents").where(is_blank("text")).agg(F.count("*").alias("n"))
