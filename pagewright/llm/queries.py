"""The checked queries of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.token_files import read_token_files, write_token_files

    path = work_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


_OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


@query("op1_decontamination", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.decontamination import find_contamination, is_contaminated

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.quality import score_documents, train

    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, train(documents, table(spark, sf_dir, "labels")))


_OP8_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS s
          FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM grams a JOIN grams b USING (s) WHERE a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.r = c.a JOIN sizes y ON y.r = c.b WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS x FROM docs UNION SELECT reach.r, l.b FROM reach JOIN both_ways l ON l.a = reach.x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM docs d LEFT JOIN sizes s USING (r)
JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN docs o ON o.r = reach.x GROUP BY reach.r) c USING (r)
"""


@query("op8_jaccard_join", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


_OP5_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


@query("op5_topk", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.topk import quantised, top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.select("vec_id", quantised(F.col("embedding")).alias("vector")))


@query("op6_main_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages"))


_OP4_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM t),
convs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM placed GROUP BY conv_id),
gone AS (SELECT DISTINCT a.conv_id FROM convs a JOIN convs b ON a.turns[1] = b.turns[1] AND a.turns = b.turns[1:len(a.turns)]
         AND (len(b.turns) > len(a.turns) OR b.conv_id < a.conv_id))
SELECT conv_id, (pos // 256)::BIGINT AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM placed WHERE conv_id NOT IN (SELECT conv_id FROM gone) GROUP BY 1, 2
"""


@query("op4_chat_collapse", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.chat import render

    return render(table(spark, sf_dir, "conversations"))


def page_captures(pages: DataFrame) -> DataFrame:
    """WARC records made of ``pages``: a response for each, and for every second one a revisit.

    Times, validators and other headers follow from the page id: a revisit comes a day later, or an hour
    earlier if the id is divisible by 10, and has another ETag if it is divisible by 6.
    """
    from pagewright.llm.warc import warc_record

    def headers(**named) -> F.Column:
        return F.create_map(*(x for k, v in named.items() for x in (F.lit(k.replace("_", "-")), v if not isinstance(v, str) else F.lit(v))))

    page = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + page * 977 % 1_000_003)
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    responses = pages.select(
        warc_record(
            F.concat(F.lit("r-"), page), F.lit("response"), F.col("url"), at, F.lit("HTTP/1.1 200 OK"),
            headers(content_type="text/html", etag=tag, server="origin", date=F.date_format(at, "yyyy-MM-dd HH:mm:ss")), F.col("html"),
        ).alias("content")
    )  # fmt: skip
    later = F.timestamp_seconds(F.unix_timestamp(at) + F.when(page % 10 == 0, -3600).otherwise(86400))
    again = headers(
        etag=F.when(page % 6 == 0, '"other"').otherwise(F.concat(F.lit("W/"), tag)), server="cache",
        date=F.date_format(later, "yyyy-MM-dd HH:mm:ss"), expires="0",
    )  # fmt: skip
    revisits = pages.where(page % 2 == 0).select(
        warc_record(F.concat(F.lit("v-"), page), F.lit("revisit"), F.col("url"), later, F.lit("HTTP/1.1 304 Not Modified"), again, F.lit("")).alias("content")
    )
    return responses.union(revisits)


_OP9_SQL = r"""
WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
  1700000000 + page_id * 977 % 1000003 AS ts, '"' || md5(html) || '"' AS tag FROM pages),
q AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[.]', '') AS host,
  regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g') AS rest FROM p),
c AS (SELECT page_id, html, ts, tag, host || regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+$', '') AS url FROM q),
v AS (SELECT 'v-' || page_id AS record_id, url, ts + CASE WHEN page_id % 10 = 0 THEN -3600 ELSE 86400 END AS ts,
  CASE WHEN page_id % 6 = 0 THEN '"other"' ELSE tag END AS tag FROM c WHERE page_id % 2 = 0),
r AS (SELECT * FROM (SELECT url, ts, 'r-' || page_id AS id, tag, html, row_number() OVER (PARTITION BY url, ts ORDER BY 'r-' || page_id DESC) AS n FROM c)
      WHERE n = 1),
j AS (SELECT v.record_id, v.url, v.ts, v.tag AS new, r.id, r.ts AS was, r.tag, r.html FROM v ASOF LEFT JOIN r ON v.url = r.url AND v.ts > r.ts),
d AS (SELECT *, CASE WHEN id IS NULL THEN 'no_response' WHEN new = tag THEN 'resolved' ELSE 'validator_mismatch' END AS result FROM j)
SELECT record_id, url, ts::BIGINT AS captured_at, result, CASE WHEN result = 'resolved' THEN id END AS response_id,
  CASE WHEN result = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S')
    || chr(10) || 'etag: W/' || new || chr(10) || 'expires: 0' || chr(10) || 'server: origin' END AS headers,
  CASE WHEN result = 'resolved' THEN md5(html) END AS body_md5
FROM d
"""


@query("op9_revisits", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.warc import read_records, resolve_revisits

    found = resolve_revisits(read_records(page_captures(table(spark, sf_dir, "pages"))))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)))
    return found.select(
        "record_id",
        "url",
        F.unix_timestamp("captured_at").alias("captured_at"),
        "result",
        "response_id",
        F.when(F.col("headers").isNotNull(), F.array_join(lines, "\n")).alias("headers"),
        F.md5("body").alias("body_md5"),
    )


@query("op7_licences")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


_OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, i, l[i] AS line,
  translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
often AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often ON lines.key = often.key GROUP BY r, doc_id
"""


@query("op11_line_dedup", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.runs import find_runs, greatest, with_loops

    docs = with_loops(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_runs(docs).select(F.col("_0").alias("doc_id"), "runs", "collapsed_sha256", greatest(F.col("runs")).alias("top"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def _crc32(key: str) -> str:
    """SQL for the crc32 of an ASCII text."""
    byte = "list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b))"
    return f"xor(list_reduce(list_transform(string_split({key}, ''), lambda ch: ord(ch)::BIGINT), lambda acc, b: {byte}, 4294967295), 4294967295)"


def _step(path: str, cost: str, letters: str) -> str:
    """SQL for a path, nine digits of cost and then its letters, with more of both."""
    return f"printf('%09d', left({path}, 9)::INTEGER + {cost}) || substr({path}, 10) || {letters}"


_OP13_SQL = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM src, range(2) AS copy(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt),
told AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  regexp_extract(text, '([^ 	-])[ 	-]*\z', 1) AS last,
  row_number() OVER (PARTITION BY conv_id, role, md5(text) ORDER BY i) AS nth FROM placed),
faulty AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM told),
walk AS (
  SELECT DISTINCT coalesce('=' || conv_id::VARCHAR, '') AS c, 0::BIGINT AS i, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM faulty
  UNION ALL
  SELECT c, i, {_step("e", "2", "'D'")},
    least({_step("s", "2", "'D'")}, CASE WHEN NOT gone AND ini = 's' THEN {_step("e", "more", "'K'")} END),
    least({_step("u", "2", "'D'")}, CASE WHEN NOT gone AND ini = 'u' THEN {_step("f", "more", "'K'")} END,
          CASE WHEN NOT gone THEN {_step("f", "more + 1", "'R'")} END),
    least({_step("a", "2", "'D'")}, CASE WHEN NOT gone AND ini = 'a' THEN {_step("u", "more", "'K'")} END,
          CASE WHEN NOT gone THEN {_step("u", "more + 1", "'R'")} END)
  FROM (SELECT w.c, r.i, r.ini, r.fault IN (1, 2) AS gone, CASE WHEN r.fault = 3 THEN 5 ELSE 0 END AS more, w.e, w.s, w.u,
          w.a, least(w.e, w.s, w.a) AS f
        FROM (SELECT c, i, e, s, u1 AS u, least(a, {_step("u1", "5", "'I'")}) AS a
              FROM (SELECT *, least(u, {_step("least(e, s, a)", "5", "'I'")}) AS u1 FROM walk)) w
        JOIN (SELECT coalesce('=' || conv_id::VARCHAR, '') AS c, i, ini, fault FROM faulty) r ON r.c = w.c AND r.i = w.i + 1)),
ends AS (SELECT c, max_by(least(e, a, {_step("u", "5", "'I'")}, {_step("s", "10", "'II'")}), i) AS best FROM walk GROUP BY c),
decided AS (SELECT c, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM ends),
letters AS (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS k FROM decided),
edits AS (SELECT c, k, substr(audit, k, 1) AS l, length(replace(left(audit, k), 'I', '')) AS i,
  length(replace(left(audit, k), 'D', '')) - 1 AS place, length(replace(audit, 'D', '')) % 2 AS sys FROM letters),
built AS (SELECT x.c, string_agg(CASE WHEN l = 'K' THEN r.role WHEN (place - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN l = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY k) AS body
  FROM edits x LEFT JOIN faulty r ON x.l <> 'I' AND coalesce('=' || r.conv_id::VARCHAR, '') = x.c AND r.i = x.i WHERE l <> 'D' GROUP BY x.c),
counts AS (SELECT coalesce('=' || conv_id::VARCHAR, '') AS c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
  count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS c FROM conversations) o
LEFT JOIN counts USING (c) LEFT JOIN decided USING (c) LEFT JOIN built USING (c)
"""


@query("op13_conversation_repair", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagewright.llm.repair import Repair, damage

    turns = table(spark, sf_dir, "conversations")
    repair = Repair(damage(turns), turns)
    found = repair.report().join(repair.digests(), "c", "left")
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )  # fmt: skip
