"""How pages are dealt out, and patterns that are skipped where they cannot match."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from pagewright.functions import html as H
from pagewright.functions import markdown as M
from pagewright.functions import text as T
from pagewright.functions import tokens as K
from pagewright.functions.core import CHANGES, EDGES, FASTER, NEEDED, WS, count_matches, replace_all
from pagewright.operators import content as C
from pagewright.operators import markdown as MD
from pagewright.operators.html_tokens import tokenize_tags
from pagewright.params import PageJobParams
from pagewright.plans.pages import page_chunks
from pagewright.plans.texts import process_texts


def test_pages_come_in_full_rounds_of_tasks(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/pages"
    spark.range(200).selectExpr("id AS page_id", "repeat(uuid(), 50) AS html").write.parquet(path)
    pages, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    for share in (1, cores, cores + 1, 3 * cores - 1):
        monkeypatch.setattr(C, "PARTITION_BYTES", size // share)
        n = C.by_page(pages).rdd.getNumPartitions()
        assert n % cores == 0 and n >= share


def test_lines_and_quotes_stay_where_their_document_is(spark, tmp_path):
    rows = [(i, t, "en", "web") for i, t in enumerate(["one\ntwo, three", "", None, "4"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = E.queries()["markdown_quotes"](spark, str(tmp_path))
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    said = {r.doc_id: r.digest for r in got.collect()}
    want = spark.range(1).select(F.md5(F.lit("> one\n\n> two three")).alias("a"), F.md5(F.lit("")).alias("b")).first()
    assert said == {0: want.a, 1: want.b, 2: want.b, 3: want.b}


STEPS = list(dict.fromkeys((*M.PRE_STEPS, *M.POST_STEPS, *M.TEXT_STEPS, *T.CLEAN_STEPS, *MD.JOIN_STEPS)))


def test_skipped_patterns_do_not_match(spark):
    r = random.Random(1)
    bits = ["\n", "\n\n", "#", "# ", "```", "`", "[a](b)", "![", "](", ")", ">", "  ", "\r", "\r\n", "x", "1. ", "- ", "é"]
    texts = [None, "", *("".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(1500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = [(p, to) for p, to in STEPS if p in NEEDED]
    assert len(steps) >= 14
    same = [replace_all("t", [s]).eqNullSafe(F.regexp_replace("t", *s)) for s in steps]
    assert df.select(*[F.min(c.cast("int")) for c in same]).first() == tuple([1] * len(steps))


# What edges, white space, marks, lists and counted forms are made of, line ends of all kinds among them.
MORE = [
    " ", "  ", "\t", "\n", "\n\n", "\r", "\r\n", "\x85", "\u2028", "\xa0", "\u3000", "x", "_y", "é", "9", "1. ", ". ", "- ", "* ", "+",
    "#", "###### ", "|", "> ", "`", "```", "](", ")", "![", "[", *map(chr, (*range(1, 9), *range(14, 22))),
]
COUNTED = [*T.STRUCTURE_PATTERNS.values(), M.FENCE, M.HEADING, M.LINK, M.IMAGE, M.LIST_ITEM, M.TABLE_ROW, "[a-zA-Z0-9_]+"]


def _random_texts(spark, bits, n=4000, most=12):
    r = random.Random(2)
    texts = [None, "", *bits, *("".join(r.choice(bits) for _ in range(r.randrange(most))) for _ in range(n))]
    return spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)


def test_shorter_ways_do_the_same_as_their_patterns(spark):
    assert all(p in FASTER or p in NEEDED for p in COUNTED)
    steps = list(dict.fromkeys((*STEPS, *H.STRIP_STEPS, *MD.LAST_STEPS, *CHANGES, *EDGES)))
    df = _random_texts(spark, MORE)
    pairs = [(replace_all("t", [s]), F.regexp_replace("t", *s)) for s in steps]
    pairs += [(count_matches("t", p), F.regexp_count("t", F.lit(p)).cast("long")) for p in COUNTED]
    pairs.append((replace_all("t", H.STRIP_STEPS), _one_by_one(H.STRIP_STEPS)))
    words = F.lit(1).cast("long")
    per_word = F.length(F.regexp_replace("t", WS, "")).cast("double")
    pairs.append((T.readability("t", words)["characters_per_word"], F.coalesce(per_word, F.lit(0.0))))
    wrong = [F.count_if(~a.eqNullSafe(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    assert sum(df.select(*wrong).first()) == 0


def _one_by_one(steps):
    c = F.col("t")
    for s in steps:
        c = F.regexp_replace(c, *s)
    return c


def test_tags_come_with_the_text_after_them(spark):
    html = "a<p>b<br><<i>c</i>d < e</p>f"
    rows = tokenize_tags(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")).collect()
    got = {k: [(r.pos, r.raw, r.text) for r in rows if r.page_id == k] for k in (1, 2, 3)}
    first = [(0, "a", ""), (1, "<p>", "b"), (3, "<br>", ""), (4, "<", ""), (5, "<i>", "c"), (7, "</i>", "d "), (9, "<", ""), (10, " e", "")]
    assert got == {1: [*first, (11, "</p>", "f"), (13, "", "")], 2: [(0, "", "")], 3: [(0, "", "")]}


def test_a_chunk_goes_to_python_once(spark):
    docs = spark.createDataFrame([(1, "u", "t", "some text " * 300), (2, "u", "t", None)], "doc_id long, url string, title string, markdown string")
    html = "<html><body><article>" + "<p>Some text, and more of it.</p>" * 90 + "</article></body></html>"
    pages = spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string")
    for rows in (process_texts(docs), page_chunks(pages, PageJobParams())):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        got = rows.select("content", "tokens", K.token_count("content").alias("want")).collect()
        assert len(got) > 2 and all(r.tokens == r.want for r in got)
