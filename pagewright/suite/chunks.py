"""Queries over chunks: splitting, positions, metadata, tokens, cost, roll-ups, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions import urls as U
from ..functions.core import is_blank
from ..operators import chunking as C
from ..operators import enrich as E
from ..operators import pieces as P
from ..operators import rollups as R
from ..operators import tokens as TK
from ..plans.texts import process_texts
from ..session import work_dir
from ..sources import sinks
from ..sources.tables import read_table
from . import duck as D
from .registry import query
from .scalars import MD_DOCS, markdown_docs

def crawled_at():
    """A fixed crawl time, so that results repeat."""
    return F.lit("2024-12-12T10:30:00Z").cast("timestamp")

SIZE, OVERLAP = 1000, 100

# A chunk table both engines can build: the lines of each document.
LINES = (
    "(SELECT doc_id, (i - 1)::BIGINT AS chunk_index, parts[i] AS content, n_chars FROM (SELECT doc_id, n_chars, "
    "str_split(text, chr(10)) AS parts, unnest(range(1, len(str_split(text, chr(10))) + 1)) AS i FROM documents))"
)
LOCATED = (
    f"(SELECT *, length(content) AS length, count(*) OVER (PARTITION BY doc_id) AS total_chunks, "
    f"CASE WHEN chunk_index = 0 THEN 0 ELSE least({OVERLAP}, floor(length(content) * 0.1::DOUBLE)::BIGINT) END AS overlap_start, "
    f"CASE WHEN chunk_index = count(*) OVER (PARTITION BY doc_id) - 1 THEN 0 ELSE least({OVERLAP}, floor(length(content) * 0.1::DOUBLE)::BIGINT) END AS overlap_end "
    f"FROM {LINES})"
)


def lines(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


def counted_lines(spark, d):
    """Lines with a made-up but repeatable token count, so that SQL can follow."""
    return lines(spark, d).withColumns(
        {
            "length": F.length("content"),
            "tokens": F.floor(F.length("content") / 4).cast("int"),
            "word_count": T.word_count("content"),
        }
    )


COUNTED = (
    f"(SELECT *, length(content) AS length, length(content) // 4 AS tokens, {D.words('content')} AS word_count FROM {LINES})"
)


def longs(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- splitting -------------------------------------------------------------


@query("chunk_split")
def chunk_split(spark, d):
    """Every document split with the default sizes."""
    return C.chunk_documents(markdown_docs(spark, d).drop("title"), "markdown", SIZE, OVERLAP)


@query(
    "chunk_split_invariants",
    f"""SELECT doc_id, true AS fits, true AS dense, true AS in_order, true AS complete FROM {MD_DOCS}
        WHERE {D.has('markdown', D.NON_WS)}""",
)
def chunk_split_invariants(spark, d):
    """Per document: no chunk too long, indexes dense, offsets in order, no visible character lost."""
    docs = markdown_docs(spark, d).select("doc_id", "markdown")
    return split_invariants(docs, 300).select("doc_id", "fits", "dense", "in_order", "complete")


def split_invariants(docs, size):
    """What holds of the chunks of docs (doc_id, markdown). Chunks carry how much their document holds, not its text."""
    visible = lambda c: F.length(F.regexp_replace(c, D.WS, ""))
    docs = docs.withColumn("visible", visible(T.clean("markdown")))
    chunks = C.chunk_documents(docs, "markdown", size, 0)
    per_doc = chunks.groupBy("doc_id").agg(
        F.bool_and(F.length("content") <= size).alias("fits"),
        ((F.count("*") == F.max("total_chunks")) & (F.max("chunk_index") == F.count("*") - 1)).alias("dense"),
        F.bool_and(F.col("end_offset") - F.col("start_offset") >= F.length("content")).alias("in_order"),
        F.sum(visible("content")).alias("n"),
        F.first("visible").alias("visible"),
    )
    return per_doc.withColumn("complete", F.col("n") == F.col("visible"))


@query(
    "chunk_text_rebuilt",
    f"SELECT doc_id, md5({D.sub(D.clean('markdown'), D.WS)}) AS digest FROM {MD_DOCS} WHERE {D.has('markdown', D.NON_WS)}",
)
def chunk_text_rebuilt(spark, d):
    """Without overlap, the chunks in order hold the cleaned text, white space aside."""
    chunks = C.chunk_documents(markdown_docs(spark, d), "markdown", 500, 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "")
    return chunks.groupBy("doc_id").agg(F.md5(F.regexp_replace(text, D.WS, "")).alias("digest"))


@query(
    "chunk_offsets",
    f"""SELECT doc_id, md5(string_agg({D.sub('c', D.WS)}, '' ORDER BY i)) AS digest FROM (
        SELECT doc_id, unnest(range(1, 1 + (length({D.clean('markdown')}) + 99) // 100)) AS i,
        substr({D.clean('markdown')}, (unnest(range(0, (length({D.clean('markdown')}) + 99) // 100)) * 100 + 1)::BIGINT, 100) AS c
        FROM {MD_DOCS}) GROUP BY doc_id""",
)
def chunk_offsets(spark, d):
    """Offsets cut the cleaned text into its chunks, so the cuts restore it."""
    docs = markdown_docs(spark, d).select("doc_id", "markdown", T.clean("markdown").alias("cleaned"))
    cut = F.expr("substr(cleaned, start_offset + 1, end_offset - start_offset)")
    chunks = C.chunk_documents(docs, "markdown", 200, 0).select("doc_id", "chunk_index", cut.alias("cut"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "cut"))), lambda c: c["cut"]), "")
    return chunks.groupBy("doc_id").agg(F.md5(F.regexp_replace(text, D.WS, "")).alias("digest"))


@query("chunk_split_by_tokens")
def chunk_split_by_tokens(spark, d):
    """Chunk size measured in tokens instead of characters."""
    return C.chunk_documents(
        markdown_docs(spark, d).drop("title"), "markdown", 200, 20, length=K.count_tokens_of
    )


@query(
    "chunk_blank_documents",
    """SELECT doc_id, CASE WHEN doc_id % 50 = 0 OR blank THEN 'chunking_failed' ELSE 'success' END AS status,
        CASE WHEN doc_id % 50 = 0 OR blank THEN 'Input text is empty' ELSE '' END AS warnings
        FROM (SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '[^[:space:]]') AS blank FROM documents)""",
)
def chunk_blank_documents(spark, d):
    """Blank documents give no chunks, a warning and a failed status."""
    docs = read_table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 50 == 0, " \n ").otherwise(F.col("text")).alias("text")
    )
    counts = C.chunk_documents(docs, "text").groupBy("doc_id").agg(F.count("*").alias("n"))
    flags = C.document_warnings(docs, "text").select(
        "doc_id", F.array_join(F.filter("warnings", lambda w: w == "Input text is empty"), "; ").alias("warnings")
    )
    status = F.when(F.col("n").isNull(), R.CHUNKING_FAILED).otherwise(R.SUCCESS)
    return flags.join(counts, "doc_id", "left").select("doc_id", status.alias("status"), "warnings")


@query(
    "chunk_positions",
    f"""SELECT doc_id, chunk_index, total_chunks, length, overlap_start, overlap_end, chunk_index = 0 AS is_first,
        chunk_index = total_chunks - 1 AS is_last FROM {LOCATED}""",
)
def chunk_positions(spark, d):
    rows = C.locate_chunks(lines(spark, d), "doc_id", OVERLAP)
    return rows.select(
        "doc_id", *longs("chunk_index", "total_chunks", "length", "overlap_start", "overlap_end"), "is_first", "is_last"
    )


@query(
    "chunk_statistics",
    f"""SELECT doc_id, count(*) AS total_chunks, {D.round_to('sum(length)::DOUBLE / count(*)', 0)}::BIGINT AS average_chunk_size,
        min(length) AS min_chunk_size, max(length) AS max_chunk_size,
        {D.round_to('(count(*) * sum(length * length) - sum(length) * sum(length))::DOUBLE / (count(*)::DOUBLE * count(*)::DOUBLE)', 0)}::BIGINT AS size_variance,
        sum(overlap_start + overlap_end)::BIGINT AS overlap_chars,
        {D.round_to('sum(overlap_start + overlap_end)::DOUBLE / max(n_chars)::DOUBLE', 3)} AS overlap_ratio,
        sum(length)::DOUBLE / max(n_chars)::DOUBLE AS compression_ratio,
        count(*)::DOUBLE / (max(n_chars)::DOUBLE / 1024.0::DOUBLE) AS chunks_per_kb FROM {LOCATED} GROUP BY doc_id""",
)
def chunk_statistics(spark, d):
    return C.chunk_stats(C.locate_chunks(lines(spark, d), "doc_id", OVERLAP), "doc_id", "n_chars")


# A damaged chunk table: some texts emptied, some indexes shifted, some overlaps too large.
DAMAGED = (
    "(SELECT doc_id, CASE WHEN doc_id % 9 = 0 AND chunk_index >= 2 THEN chunk_index + 1 ELSE chunk_index END AS chunk_index, "
    "CASE WHEN chunk_index % 5 = 3 THEN '' ELSE content END AS content, length, "
    "CASE WHEN chunk_index % 4 = 1 THEN 120 ELSE overlap_start END AS overlap_start FROM " + LOCATED + ")"
)


@query(
    "chunk_validation",
    f"""WITH r AS (SELECT *, row_number() OVER w - 1 AS p, lag(length) OVER w AS prev FROM {DAMAGED}
                   WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
        SELECT doc_id, chunk_index, 'content' AS kind, 'error' AS severity, 'Chunk ' || p || ' has invalid content' AS message
        FROM r WHERE content = '' UNION ALL
        SELECT doc_id, chunk_index, 'index', 'warning', 'Chunk ' || p || ' has mismatched index: ' || chunk_index FROM r WHERE chunk_index <> p UNION ALL
        SELECT doc_id, chunk_index, 'size', 'warning', 'Chunk ' || p || ' exceeds expected size: ' || length || ' chars' FROM r WHERE length > 300 * 1.5 UNION ALL
        SELECT doc_id, chunk_index, 'overlap', 'warning', 'Chunk ' || p || ' has excessive overlap start: ' || overlap_start FROM r
        WHERE p > 0 AND overlap_start > least({OVERLAP}, prev, length) * 1.2""",
)
def chunk_validation(spark, d):
    rows = C.locate_chunks(lines(spark, d), "doc_id", OVERLAP)
    i = F.col("chunk_index")
    damaged = rows.select(
        "doc_id",
        F.when((F.col("doc_id") % 9 == 0) & (i >= 2), i + 1).otherwise(i).alias("chunk_index"),
        F.when(i % 5 == 3, "").otherwise(F.col("content")).alias("content"),
        "length",
        F.when(i % 4 == 1, 120).otherwise(F.col("overlap_start")).alias("overlap_start"),
    )
    issues = C.validate_chunks(damaged, "doc_id", 300, OVERLAP)
    return issues.withColumn("chunk_index", F.col("chunk_index").cast("long"))


# --- metadata --------------------------------------------------------------

SOURCES = (
    "(SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'no url' WHEN page_id % 6 = 1 THEN '' ELSE url END AS url, "
    "CASE WHEN page_id % 4 = 0 THEN '  ' ELSE 'Page ' || page_id END AS title FROM pages)"
)


def sources(spark, d):
    k = F.col("page_id")
    return read_table(spark, d, "pages").select(
        "page_id",
        F.when(k % 6 == 0, "no url").when(k % 6 == 1, "").otherwise(F.col("url")).alias("url"),
        F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("Page "), k.cast("string"))).alias("title"),
    )


@query(
    "source_metadata",
    f"""SELECT page_id, CASE WHEN {D.u_valid('url')} THEN url ELSE '' END AS url, {D.u_host('url')} AS domain,
        CASE WHEN trim(title) <> '' THEN title WHEN {D.u_host('url')} <> '' THEN {D.u_host('url')} ELSE 'Unknown' END AS title,
        '' AS description, 'text/markdown' AS content_type FROM {SOURCES}""",
)
def source_metadata(spark, d):
    df = sources(spark, d)
    return df.select("page_id", E.source_metadata(df, crawled_at()).alias("s")).select(
        "page_id", "s.url", "s.domain", "s.title", "s.description", "s.content_type"
    )


@query(
    "source_warnings",
    f"""SELECT page_id, {D.case_join(
        (f"url <> '' AND NOT {D.u_valid('url')}", "'Invalid source URL: ' || url"),
        ("url = ''", "'No source URL provided'"), ("trim(title) = ''", "'No source title provided'"))} AS warnings FROM {SOURCES}""",
)
def source_warnings(spark, d):
    return sources(spark, d).select("page_id", F.array_join(E.source_warnings("url", "title"), "; ").alias("warnings"))


def enriched_lines(spark, d, **options):
    rows = C.locate_chunks(lines(spark, d), "doc_id", OVERLAP).withColumn(
        "url", F.concat(F.lit("https://docs.example.com/"), F.col("doc_id").cast("string"))
    )
    return E.enrich(rows, crawled_at(), SIZE, OVERLAP, **options)


@query(
    "processing_metadata",
    f"""SELECT doc_id, chunk_index, total_chunks, length AS chunk_size, 'langchain-recursive' AS processing_method,
        'unknown' AS extraction_method FROM {LOCATED}""",
)
def processing_metadata(spark, d):
    p = enriched_lines(spark, d).select("doc_id", "processing.*")
    return p.select("doc_id", *longs("chunk_index", "total_chunks", "chunk_size"), "processing_method", "extraction_method")


@query(
    "custom_enrichers",
    f"""SELECT doc_id, chunk_index, reverse(substr(content, 1, 3)) AS head, 'v1' AS release,
        CASE WHEN chunk_index % 2 = 0 THEN 'even' ELSE 'base' END AS parity FROM {LINES}""",
)
def custom_enrichers(spark, d):
    """Three enrichers: one adds, one overrides a key on some rows, one fails and is skipped."""
    text = "map<string,string>"

    def head(content, so_far, index):
        return F.create_map(F.lit("head"), F.reverse(F.substring(content, 1, 3)))

    def parity(content, so_far, index):
        return F.when(index % 2 == 0, F.create_map(F.lit("parity"), F.lit("even")))

    def failing(content, so_far, index):
        return F.lit(None).cast(text)

    base = F.create_map(F.lit("release"), F.lit("v1"), F.lit("parity"), F.lit("base"))
    rows = enriched_lines(spark, d, custom=base, enrichers=[head, parity, failing])
    return rows.select(
        "doc_id", *longs("chunk_index"), *[F.col("custom")[k].alias(k) for k in ("head", "release", "parity")]
    )


@query(
    "enricher_faults",
    f"""SELECT doc_id, chunk_index, CASE WHEN chunk_index % 7 = 3 THEN 'Custom enricher failed: no line ' || chunk_index ELSE '' END AS error,
        CASE WHEN chunk_index % 7 = 3 THEN 'release=v1' WHEN chunk_index % 2 = 0 THEN 'n=' || length(content) ELSE 'n=' || length(content) || ',release=v1' END AS custom
        FROM {LINES}""",
)
def enricher_faults(spark, d):
    """A Python enricher that raises on some rows, and removes a key on others."""

    def sized(content, so_far, index):
        if index % 7 == 3:
            raise ValueError(f"no line {index}")
        if index % 2 == 0:
            so_far.pop("release")
        return so_far | {"n": len(content)}

    base = F.create_map(F.lit("release"), F.lit("v1"))
    rows = enriched_lines(spark, d, custom=base, enrichers=[E.python_enricher(sized)])
    pairs = F.transform(F.array_sort(F.map_entries("custom")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "doc_id", *longs("chunk_index"), F.coalesce("processing.error", F.lit("")).alias("error"), F.array_join(pairs, ",").alias("custom")
    )


@query(
    "metadata_size_limit",
    f"""SELECT doc_id, chunk_index, length(content) % 2 = 0 AS has_structure, CASE WHEN length(content) % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS custom_keys
        FROM {LINES}""",
)
def metadata_size_limit(spark, d):
    """A long custom field pushes the rows with texts of odd length over a limit of 5,000 characters."""
    def pad(content, so_far, index):
        return F.create_map(F.lit("pad"), F.repeat(F.lit("x"), F.length(content) % 2 * 5000))

    rows = enriched_lines(spark, d, enrichers=[pad], max_metadata_size=5000)
    return rows.select(
        "doc_id", *longs("chunk_index"),
        F.col("content_meta.structure").isNotNull().alias("has_structure"),
        F.size("custom").cast("long").alias("custom_keys"),
    )


@query(
    "enrichment_failures",
    f"""SELECT doc_id, chunk_index, CASE WHEN chunk_index % 10 = 0 THEN 'content must be a string' ELSE '' END AS error,
        chunk_index % 10 <> 0 AS analysed FROM {LINES}""",
)
def enrichment_failures(spark, d):
    """Rows that cannot be analysed stay, with the reason in processing.error."""
    rows = lines(spark, d).withColumns(
        {
            "content": F.when(F.col("chunk_index") % 10 != 0, F.col("content")),
            "url": F.lit("https://docs.example.com/"), "total_chunks": F.lit(1),
        }
    )
    return E.enrich(rows, crawled_at()).select(
        "doc_id", *longs("chunk_index"),
        F.coalesce("processing.error", F.lit("")).alias("error"),
        F.col("content_meta").isNotNull().alias("analysed"),
    )


@query(
    "enrichment_statistics",
    f"""SELECT content_type, count(*) AS n, sum(length(content))::BIGINT AS total_length,
        (avg(length(content)))::DOUBLE AS average_length FROM (SELECT content, {D.content_type('content')} AS content_type FROM
        (SELECT markdown AS content FROM {MD_DOCS})) GROUP BY content_type""",
)
def enrichment_statistics(spark, d):
    docs = markdown_docs(spark, d)
    n = F.length("markdown").cast("long")
    return (
        docs.select(T.content_type(T.structure("markdown")).alias("content_type"), n.alias("n"))
        .groupBy("content_type")
        .agg(F.count("*").alias("c"), F.sum("n").alias("total_length"))
        .select("content_type", F.col("c").alias("n"), "total_length", (F.col("total_length") / F.col("c")).alias("average_length"))
    )


@query("enrichment_report")
def enrichment_report(spark, d):
    """Metadata sizes and the content-type histogram over all lines."""
    return E.enrichment_stats(enriched_lines(spark, d))


@query(
    "enrichment_report_types",
    f"""WITH c AS (SELECT {D.content_type('content')} AS content_type, length(content) AS n FROM {LOCATED})
        SELECT content_type, count(*) AS chunks, (SELECT count(*) FROM c) AS total_chunks, 1.0::DOUBLE AS enrichment_success,
        (SELECT sum(n)::DOUBLE / count(*)::DOUBLE FROM c) AS average_content_length, true AS sizes_agree FROM c GROUP BY content_type""",
)
def enrichment_report_types(spark, d):
    """The corpus report, one row for each content type."""
    report = E.enrichment_stats(enriched_lines(spark, d))
    average = F.floor(F.col("total_metadata_size") / F.col("total_chunks") + 0.5)
    return report.select(
        F.explode("content_types").alias("content_type", "chunks"), "total_chunks", "enrichment_success", "average_content_length",
        (F.col("average_metadata_size") == average).alias("sizes_agree"),
    )


# --- tokens ----------------------------------------------------------------


@query("token_counts")
def token_counts(spark, d):
    """Counts through the dictionary of pieces, and the columns that follow from them."""
    rows = markdown_docs(spark, d).withColumnRenamed("markdown", "content")
    return TK.with_token_columns(P.count_by_pieces(rows, ["doc_id"]), "content").drop("content")


@query("token_counts_equal_direct", f"SELECT doc_id, true AS same FROM {MD_DOCS}")
def token_counts_equal_direct(spark, d):
    """The sum over pieces is what the tokenizer says of the whole text."""
    rows = markdown_docs(spark, d).select("doc_id", F.col("markdown").alias("content"))
    counted = P.count_by_pieces(rows, ["doc_id"])
    return counted.select("doc_id", (F.col("tokens") == K.token_count("content")).alias("same"))


# Pieces that hold more than white space; how white space itself is cut needs a look-ahead, which DuckDB's patterns lack.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{N}]+"


@query(
    "token_pieces",
    f"SELECT md5(piece) AS digest, count(*) AS n FROM (SELECT unnest(regexp_extract_all(markdown, {D.q(_PIECE)})) AS piece FROM {MD_DOCS}) GROUP BY piece",
)
def token_pieces(spark, d):
    """The dictionary: how often each different piece stands in all documents."""
    known = P.piece_dictionary(markdown_docs(spark, d), "markdown")
    return known.where(F.col("key").rlike(r"(?U)\S")).select(F.md5(F.col("key").cast("binary")).alias("digest"), "n")


@query(
    "token_dictionary_size",
    f"""SELECT count(DISTINCT piece) AS pieces, count(*) AS places, count(DISTINCT piece) < count(*) / 10 AS small
        FROM (SELECT unnest(regexp_extract_all(markdown, {D.q(_PIECE)})) AS piece FROM {MD_DOCS})""",
)
def token_dictionary_size(spark, d):
    """How much less there is to encode."""
    known = P.piece_dictionary(markdown_docs(spark, d), "markdown").where(F.col("key").rlike(r"(?U)\S"))
    pieces, places = F.count("*"), F.sum("n")
    return known.agg(pieces.alias("pieces"), places.alias("places"), (pieces < places / 10).alias("small"))


@query(
    "token_store_second_run",
    """WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 10000000, text || ' more' FROM documents),
       seen AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)
       SELECT doc_id, text IS NOT NULL AND text IN (SELECT text FROM seen) AS reused FROM t""",
)
def token_store_second_run(spark, d):
    """A run over all documents, then one over them and as many new texts: only the new are encoded."""
    store = P.TokenStore(spark, work_dir(spark, "token-store"))
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    store.count(docs, "first", ["doc_id"])
    more = docs.select((F.col("doc_id") + 10000000).alias("doc_id"), F.concat("content", F.lit(" more")).alias("content"))
    return store.count(docs.union(more), "second", ["doc_id"]).select("doc_id", "reused")


@query(
    "token_ratios",
    f"""SELECT doc_id, chunk_index, tokens, {D.round_to(D.div('tokens', 'length'), 3)} AS tokens_per_character,
        {D.round_to(D.div('tokens', 'word_count'), 2)} AS tokens_per_word,
        {D.round_to('tokens::DOUBLE / 1000.0::DOUBLE * 0.03::DOUBLE', 5)} AS cost FROM {COUNTED}""",
)
def token_ratios(spark, d):
    rows = TK.with_token_columns(counted_lines(spark, d), "content", "gpt-4")
    return rows.select(
        "doc_id", *longs("chunk_index", "tokens"), "tokens_per_character", "tokens_per_word", "cost"
    )


@query(
    "token_warnings",
    f"""SELECT doc_id, chunk_index, {D.case_join(
        ("length = 0", "'Empty text provided'"),
        ("t > 8000", "'High token count (' || t || ') may exceed model limits'"),
        ("length > 0 AND t::DOUBLE / length > 0.5", "'High tokens-per-character ratio suggests complex text'"))} AS warnings
        FROM (SELECT *, tokens * (chunk_index % 40) AS t FROM {COUNTED})""",
)
def token_warnings(spark, d):
    t = (F.col("tokens") * (F.col("chunk_index") % 40)).cast("long")
    return counted_lines(spark, d).select(
        "doc_id", *longs("chunk_index"), F.array_join(K.token_warnings(t, F.col("length")), "; ").alias("warnings")
    )


_PRICES = ", ".join(f"('{m}', {p}::DOUBLE)" for m, p in {**K.MODEL_PRICES, "gpt-4": 0.05, "house-model": 0.002}.items())
MODELS = ("gpt-3.5-turbo", "gpt-4", "text-embedding-3-small", "house-model", "nobody-knows")
_MODEL_SQL = f"[{', '.join(D.q(m) for m in MODELS)}][doc_id % {len(MODELS)} + 1]"


@query(
    "token_cost_by_model",
    f"""SELECT doc_id, chunk_index, model, {D.round_to('tokens::DOUBLE / 1000.0::DOUBLE * coalesce(usd, 0.0::DOUBLE)', 5)} AS cost
        FROM (SELECT *, {_MODEL_SQL} AS model FROM {COUNTED}) LEFT JOIN (VALUES {_PRICES}) p(m, usd) ON m = model""",
)
def token_cost_by_model(spark, d):
    """Price table with overrides joined on the model; unknown models cost nothing."""
    prices = {**K.MODEL_PRICES, "gpt-4": 0.05, "house-model": 0.002}
    table = spark.createDataFrame(list(prices.items()), "model string, usd_per_1k double")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("doc_id") % len(MODELS) + 1).cast("int"))
    rows = counted_lines(spark, d).withColumn("model", model)
    return TK.price_join(rows, table).select("doc_id", *longs("chunk_index"), "model", "cost")


_VAR = "(count(*) * sum(tokens * tokens) - sum(tokens) * sum(tokens))::DOUBLE / (count(*)::DOUBLE * count(*)::DOUBLE)"
_COST = D.round_to("tokens::DOUBLE / 1000.0::DOUBLE * 0.0015::DOUBLE", 5)


@query(
    "token_batch_totals",
    f"""SELECT count(*) AS chunks, sum(tokens)::BIGINT AS total_tokens, sum(length)::BIGINT AS total_characters,
        sum(word_count)::BIGINT AS total_words, {D.round_to('sum(tokens)::DOUBLE / count(*)', 0)}::BIGINT AS average_tokens,
        sum(round({_COST} * 100000)::BIGINT)::DOUBLE / 100000 AS total_cost, min(tokens) AS min_tokens, max(tokens) AS max_tokens,
        sum(tokens)::DOUBLE / sum(length)::DOUBLE AS tokens_per_character, sum(tokens)::DOUBLE / sum(word_count)::DOUBLE AS tokens_per_word,
        {_VAR} AS variance, sqrt({_VAR}) AS standard_deviation FROM {COUNTED}""",
)
def token_batch_totals(spark, d):
    return TK.batch_totals(TK.with_token_columns(counted_lines(spark, d), "content"))


@query(
    "token_distribution",
    f"""WITH s AS (SELECT tokens, row_number() OVER (ORDER BY tokens) - 1 AS r, count(*) OVER () AS n FROM {COUNTED})
        SELECT max(CASE WHEN r = floor(n * 0.25) THEN tokens END) AS q1, max(CASE WHEN r = floor(n * 0.75) THEN tokens END) AS q3,
        (max(CASE WHEN r = (n - 1) // 2 THEN tokens END) + max(CASE WHEN r = n // 2 THEN tokens END)) / 2.0::DOUBLE AS median,
        {_VAR} AS variance, sqrt({_VAR}) AS standard_deviation FROM s""",
)
def token_distribution(spark, d):
    return TK.token_distribution(counted_lines(spark, d))


@query(
    "token_sorted_counts",
    f"SELECT tokens, count(*) AS n FROM {COUNTED} GROUP BY tokens ORDER BY tokens",
)
def token_sorted_counts(spark, d):
    return counted_lines(spark, d).groupBy(*longs("tokens")).agg(F.count("*").alias("n")).orderBy("tokens")


@query(
    "token_chunk_fields",
    f"""SELECT doc_id, chunk_index, 'https://docs.example.com/' || doc_id AS source_url, length AS chunk_size,
        overlap_start > 0 OR overlap_end > 0 AS has_overlap, length // 4 AS tokens FROM {LOCATED}""",
)
def token_chunk_fields(spark, d):
    """Token results with the fields of their chunk."""
    rows = enriched_lines(spark, d).withColumn("tokens", F.floor(F.length("content") / 4).cast("int"))
    return rows.select(
        "doc_id", *longs("chunk_index"), F.col("source.url").alias("source_url"),
        F.col("processing.chunk_size").cast("long").alias("chunk_size"),
        ((F.col("overlap_start") > 0) | (F.col("overlap_end") > 0)).alias("has_overlap"), *longs("tokens"),
    )


@query(
    "token_reuse",
    "SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents",
)
def token_reuse(spark, d):
    """Each distinct text is counted once; the copies share the count."""
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return TK.count_with_reuse(docs, ["doc_id"]).select("doc_id", "copies")


@query(
    "token_reuse_equals_direct",
    "SELECT doc_id, true AS same FROM documents",
)
def token_reuse_equals_direct(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    reused = TK.count_with_reuse(docs, ["doc_id"])
    return reused.select("doc_id", (F.col("tokens") == K.token_count("content")).alias("same"))


@query(
    "token_bad_text",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR text IS NULL THEN 'Invalid text format' WHEN doc_id % 3 = 1 OR text = '' THEN 'Empty text provided'
        ELSE '' END AS warnings, doc_id % 3 = 2 AND regexp_matches(coalesce(text, ''), '[^[:space:]]') AS counted FROM documents""",
)
def token_bad_text(spark, d):
    """NULL text gets a zero row with a message; the batch goes on."""
    k = F.col("doc_id") % 3
    text = F.when((k == 1) & F.col("text").isNotNull(), "").when(k == 2, F.col("text"))
    bad = F.filter("token_warnings", lambda w: w.isin("Invalid text format", "Empty text provided"))
    return TK.with_tokens(read_table(spark, d, "documents").select("doc_id", text.alias("content"))).select(
        "doc_id", F.array_join(bad, "; ").alias("warnings"), (F.col("tokens") > 0).alias("counted")
    )


# --- joins and roll-ups ----------------------------------------------------


@query(
    "chunk_token_join",
    f"""SELECT doc_id, chunk_index, CASE WHEN chunk_index % 7 = 6 THEN 0 ELSE tokens END AS tokens,
        CASE WHEN chunk_index % 7 = 6 THEN 0.0::DOUBLE ELSE {_COST} END AS cost FROM {COUNTED}""",
)
def chunk_token_join(spark, d):
    """Chunks joined with token results, some of which are missing."""
    rows = TK.with_token_columns(counted_lines(spark, d), "content")
    results = rows.where(F.col("chunk_index") % 7 != 6).select(
        "doc_id", "chunk_index", "tokens", "cost", "tokens_per_character", "tokens_per_word"
    )
    joined = R.join_token_results(lines(spark, d), results, ["doc_id", "chunk_index"])
    return joined.select("doc_id", *longs("chunk_index", "tokens"), "cost")


@query(
    "document_rollup",
    f"""SELECT doc_id, count(*) AS total_chunks, sum(tokens)::BIGINT AS total_tokens, sum(word_count)::BIGINT AS total_words
        FROM {COUNTED} GROUP BY doc_id""",
)
def document_rollup(spark, d):
    return R.page_rollup(counted_lines(spark, d), ["doc_id"])


STATUS = (
    "[CASE WHEN doc_id % 13 = 0 THEN 'request_failed' WHEN doc_id % 11 = 0 THEN 'extraction_failed' ELSE 'success' END][1]"
)


def _status():
    return (
        F.when(F.col("doc_id") % 13 == 0, R.REQUEST_FAILED)
        .when(F.col("doc_id") % 11 == 0, R.EXTRACTION_FAILED)
        .otherwise(R.SUCCESS)
    )


_RUN = f"""(SELECT count(*) AS total_requests, count(*) FILTER (status = 'success') AS successful_requests,
    count(*) FILTER (status = 'request_failed') AS failed_requests, count(*) FILTER (status = 'extraction_failed') AS failed_extractions,
    sum(total_chunks)::BIGINT AS total_chunks, sum(total_tokens)::BIGINT AS total_tokens
    FROM (SELECT {STATUS} AS status, count(*) AS total_chunks, sum(tokens) AS total_tokens FROM {COUNTED} GROUP BY doc_id))"""


@query(
    "run_totals",
    f"SELECT *, {D.round_to('successful_requests::DOUBLE / total_requests * 100', 0)}::BIGINT AS success_rate FROM {_RUN}",
)
def run_totals(spark, d):
    return R.run_totals(document_rollup(spark, d).withColumn("status", _status()))


@query(
    "run_rates",
    f"""SELECT {D.round_to('successful_requests::DOUBLE / total_requests * 100', 0)}::BIGINT AS success_rate,
        {D.round_to('successful_requests / 7.0::DOUBLE', 0)}::BIGINT AS pages_per_second,
        {D.round_to('total_chunks::DOUBLE / successful_requests', 0)}::BIGINT AS chunks_per_page,
        {D.round_to('total_tokens::DOUBLE / total_chunks', 0)}::BIGINT AS tokens_per_chunk FROM {_RUN}""",
)
def run_rates(spark, d):
    return R.crawl_rates(document_rollup(spark, d).withColumn("status", _status()), 7.0)


_STAGES = f"""WITH c AS (SELECT l.doc_id, l.chunk_index, l.content, l.length, l.overlap_start, l.overlap_end, l.length // 4 AS tokens, w.word_count
        FROM {LOCATED} l JOIN {COUNTED} w ON l.doc_id = w.doc_id AND l.chunk_index = w.chunk_index),
    s AS (SELECT tokens, row_number() OVER (ORDER BY tokens) - 1 AS r, count(*) OVER () AS n FROM c),
    moments AS (SELECT (count(*) * sum(tokens * tokens) - sum(tokens) * sum(tokens))::DOUBLE / (count(*)::DOUBLE * count(*)::DOUBLE) AS v FROM c),
    t AS (SELECT count(*) AS n, sum(length) AS v, sum(tokens) AS k, sum(word_count) AS w FROM c),
    o AS (SELECT sum(overlap_start + overlap_end) AS v FROM c), d AS (SELECT sum(n_chars) AS v FROM documents)
    SELECT 'chunking' AS stage, 'total_chunks' AS metric, count(*)::DOUBLE AS value FROM c
    UNION ALL SELECT 'chunking', 'max_chunk_size', max(length)::DOUBLE FROM c
    UNION ALL SELECT 'chunking', 'min_chunk_size', min(length)::DOUBLE FROM c
    UNION ALL SELECT 'chunking', 'overlap_chars', sum(overlap_start + overlap_end)::DOUBLE FROM c
    UNION ALL SELECT 'tokenization', 'total_tokens', sum(tokens)::DOUBLE FROM c
    UNION ALL SELECT 'tokenization', 'total_characters', sum(length)::DOUBLE FROM c
    UNION ALL SELECT 'tokenization', 'total_words', sum(word_count)::DOUBLE FROM c
    UNION ALL SELECT 'tokenization', 'min_tokens', min(tokens)::DOUBLE FROM c
    UNION ALL SELECT 'tokenization', 'max_tokens', max(tokens)::DOUBLE FROM c
    UNION ALL SELECT 'distribution', 'q1', max(CASE WHEN r = floor(n * 0.25) THEN tokens END)::DOUBLE FROM s
    UNION ALL SELECT 'distribution', 'q3', max(CASE WHEN r = floor(n * 0.75) THEN tokens END)::DOUBLE FROM s
    UNION ALL SELECT 'distribution', 'variance', v FROM moments
    UNION ALL SELECT 'distribution', 'standard_deviation', sqrt(v) FROM moments
    UNION ALL SELECT 'distribution', 'median', median(tokens)::DOUBLE FROM s
    UNION ALL SELECT 'chunking', 'average_chunk_size', {D.round_to('sum(length)::DOUBLE / count(*)::DOUBLE', 0)}::DOUBLE FROM c
    UNION ALL SELECT 'chunking', 'size_variance', {D.round_to('(count(*) * sum(length * length) - sum(length) * sum(length))::DOUBLE / (count(*)::DOUBLE * count(*)::DOUBLE)', 0)}::DOUBLE FROM c
    UNION ALL SELECT 'chunking', 'overlap_ratio', {D.round_to('o.v::DOUBLE / d.v::DOUBLE', 3)} FROM o, d
    UNION ALL SELECT 'chunking', 'compression_ratio', t.v::DOUBLE / d.v::DOUBLE FROM t, d
    UNION ALL SELECT 'chunking', 'chunks_per_kb', t.n::DOUBLE / (d.v::DOUBLE / 1024.0::DOUBLE) FROM t, d
    UNION ALL SELECT 'tokenization', 'chunks', n::DOUBLE FROM t
    UNION ALL SELECT 'tokenization', 'average_tokens', {D.round_to('k::DOUBLE / n::DOUBLE', 0)}::DOUBLE FROM t
    UNION ALL SELECT 'tokenization', 'total_cost', sum(round({D.round_to('tokens::DOUBLE / 1000.0::DOUBLE * 0.0015::DOUBLE', 5)} * 100000)::BIGINT)::DOUBLE / 100000.0::DOUBLE FROM c
    UNION ALL SELECT 'tokenization', 'tokens_per_character', k::DOUBLE / v::DOUBLE FROM t
    UNION ALL SELECT 'tokenization', 'tokens_per_word', k::DOUBLE / w::DOUBLE FROM t
    UNION ALL SELECT 'tokenization', 'variance', v FROM moments
    UNION ALL SELECT 'tokenization', 'standard_deviation', sqrt(v) FROM moments
    UNION ALL SELECT 'performance', 'total_processing_time', 2500.0::DOUBLE
    UNION ALL SELECT 'performance', 'chunks_per_second', n::DOUBLE / 2.5::DOUBLE FROM t
    UNION ALL SELECT 'performance', 'tokens_per_second', k::DOUBLE / 2.5::DOUBLE FROM t
    UNION ALL SELECT 'performance', 'average_time_per_chunk', 2500.0::DOUBLE / n::DOUBLE FROM t
    UNION ALL SELECT 'content_types', {D.content_type('content')}, count(*)::DOUBLE FROM c GROUP BY 2
    UNION ALL SELECT 'enrichment', 'total_chunks', count(*)::DOUBLE FROM c
    UNION ALL SELECT 'enrichment', 'enrichment_success', 1.0::DOUBLE
    UNION ALL SELECT 'enrichment', 'average_content_length', sum(length)::DOUBLE / count(*)::DOUBLE FROM c"""


@query("stage_statistics", _STAGES)
def stage_statistics(spark, d):
    """All statistics of a run that took 2.5 seconds, as long rows; sizes of metadata, which SQL cannot state, are left to the tests."""
    rows = TK.with_token_columns(enriched_lines(spark, d).withColumn("tokens", F.floor(F.length("content") / 4).cast("int")), "content")
    stats = R.stage_stats(rows, "doc_id", "n_chars", processing_ms=2500.0)
    return stats.where(~F.col("metric").contains("metadata_size"))


@query(
    "message_union",
    f"""SELECT 'Invalid source URL: ' || url AS message, url, 'crawler' AS source FROM {SOURCES} WHERE url <> '' AND NOT {D.u_valid('url')}
        UNION ALL SELECT 'No source title provided', CASE WHEN page_id % 8 = 0 THEN '' ELSE url END, 'processing' FROM {SOURCES} WHERE trim(title) = ''""",
)
def message_union(spark, d):
    """Messages of two components; a missing url becomes ''."""
    df = sources(spark, d)
    crawler = df.where((F.col("url") != "") & ~U.is_http_url("url")).select(
        F.concat(F.lit("Invalid source URL: "), "url").alias("message"), "url"
    )
    processing = df.where(is_blank("title")).select(
        F.lit("No source title provided").alias("message"),
        F.when(F.col("page_id") % 8 != 0, F.col("url")).alias("url"),
    )
    return R.union_messages(crawler=crawler, processing=processing)


@query(
    "head_sample",
    "SELECT url FROM pages ORDER BY page_id LIMIT 3",
)
def head_sample(spark, d):
    """The first three seeds, the sample the run report shows."""
    return read_table(spark, d, "pages").orderBy("page_id").limit(3).select("url")


# --- whole text job and sinks ------------------------------------------------


@query("text_job")
def text_job(spark, d):
    """Split, enrich and count all documents."""
    return process_texts(markdown_docs(spark, d), "markdown", crawled_at=crawled_at())


@query(
    "text_job_totals",
    f"""SELECT count(DISTINCT doc_id) AS documents, count(*) = count(DISTINCT doc_id) AS one_row_each,
        count(*) FILTER (NOT coalesce({D.has('markdown', D.NON_WS)}, false)) AS failed FROM {MD_DOCS}""",
)
def text_job_totals(spark, d):
    """Every document comes out of the text job once, those without text as failed."""
    per_doc = R.page_rollup(text_job(spark, d), ["doc_id", "status"])
    return per_doc.agg(
        F.count_distinct("doc_id").alias("documents"),
        (F.count("*") == F.count_distinct("doc_id")).alias("one_row_each"),
        F.count_if(F.col("status") == "chunking_failed").alias("failed"),
    )


@query(
    "nested_records",
    f"""SELECT doc_id, count(*) AS total_chunks, sum(tokens)::BIGINT AS total_tokens, sum(word_count)::BIGINT AS total_words,
        md5(string_agg(chunk_index || ':' || content, '|' ORDER BY chunk_index)) AS digest FROM {COUNTED} GROUP BY doc_id""",
)
def nested_records(spark, d):
    """Nested page records; the chunks in order are shown as one digest."""
    nested = R.nest_chunks(counted_lines(spark, d), ["doc_id"], ["content", "tokens", "word_count"])
    line = F.transform("chunks", lambda c: F.concat(c["chunk_index"].cast("string"), F.lit(":"), c["content"]))
    return nested.select("doc_id", "total_chunks", "total_tokens", "total_words", F.md5(F.array_join(line, "|")).alias("digest"))


def flat_records(spark, d):
    rows = C.locate_chunks(lines(spark, d), "doc_id", OVERLAP).withColumns(
        {
            "url": F.concat(F.lit("https://s"), (F.col("doc_id") % 5).cast("string"), F.lit(".example.com/"), F.col("doc_id").cast("string")),
            "title": F.lit(None).cast("string"),
            "tokens": F.floor(F.length("content") / 4).cast("int"),
        }
    )
    return sinks.chunk_records(rows, crawled_at())


_FLAT = f"""SELECT u || '#chunk-' || chunk_index AS chunk_id, 's' || doc_id % 5 || '.example.com' AS domain, '' AS title, chunk_index, total_chunks,
        length AS chunk_size, length // 4 AS token_count, overlap_start > 0 OR overlap_end > 0 AS has_overlap
        FROM (SELECT *, 'https://s' || doc_id % 5 || '.example.com/' || doc_id AS u FROM {LOCATED})"""


@query("flat_records", _FLAT)
def flat_records_query(spark, d):
    return flat_records(spark, d).select(
        "chunk_id", "domain", "title", *longs("chunk_index", "total_chunks", "chunk_size", "token_count"), "has_overlap"
    )


@query("flat_records_by_domain", f"SELECT domain, count(*) AS n, sum(chunk_size)::BIGINT AS chars FROM ({_FLAT}) GROUP BY domain")
def flat_records_by_domain(spark, d):
    """Flat records written by domain and read back."""
    path = work_dir(spark, "chunk-records")
    sinks.write_chunk_records(flat_records(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy("domain").agg(F.count("*").alias("n"), F.sum("chunk_size").alias("chars"))
