"""Hand-worked cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import markdown as M
from pagewright.functions import text as T
from pagewright.functions import tokens as K
from pagewright.functions import urls as U
from pagewright.operators import failures as X
from pagewright.operators import metrics as N
from pagewright.operators.chunking import overlap_estimate
from pagewright.params import PageJobParams, ParameterError


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_hash_words_and_structure(spark):
    urls = ["unknown", "a", "https://docs.python.org/3/tutorial/introduction.html", "éà汉 abc"]
    assert one(spark, *[T.hash36(F.lit(u)) for u in urls]) == ("4pl4mu", "2p", "4c210j", "sd0drg")
    # a character beyond the basic plane counts as its two UTF-16 units: 0xD83D * 31 + 0xDE00
    assert int(one(spark, T.hash36(F.lit("😀")))[0], 36) == 0xD83D * 31 + 0xDE00
    assert one(spark, T.word_count(F.lit("été naïve a_b")))[0] == 4
    s = one(spark, T.structure(F.lit("![a](b) [c](d)\n```\n```\n```")))[0]
    assert (s.links, s.images, s.code_blocks) == (2, 1, 1.5)


def test_excerpts(spark):
    dot = "x" * 119 + ". " + "y" * 200
    space = "x" * 50 + ". " + "y" * 100 + " " + "z" * 200
    got = one(spark, *[H.excerpt(F.lit(t)) for t in ("a" * 300, dot, space, "short")])
    assert got[0] == "a" * 200 + "..."
    assert len(got[1]) == 120 and got[1].endswith(".")
    assert len(got[2]) == 155 and got[2].endswith("yy...")
    assert got[3] == "short"


def test_scores(spark):
    def score(n, p, h, lists, links):
        html = "<p>" * p + "<h2>" * h + "<ul>" * lists + "<a>" * links
        return H.content_score(F.lit("x" * n), F.lit(html))

    got = one(spark, score(1000, 3, 1, 1, 2), score(100, 0, 0, 1, 10), score(20000, 0, 0, 0, 0), score(200, 1, 0, 0, 12))
    assert got == (30.0, 0.0, 100.0, 0.0)


def test_cost_and_token_warnings(spark):
    def cost(n, model):
        return K.cost(F.lit(n), K.price_of(F.lit(model)))

    assert one(spark, cost(387, "gpt-3.5-turbo"), cost(8001, "gpt-4"), cost(8001, "other")) == (0.00058, 0.24003, 0.0)
    high = one(spark, K.token_warnings(F.lit(8001), F.lit(50000)), K.token_warnings(F.lit(8000), F.lit(50000)))
    assert high == (["High token count (8001) may exceed model limits"], [])


def test_overlap_estimate(spark):
    def est(n):
        return overlap_estimate(F.lit(n), 100, F.lit(True))

    assert one(spark, est(950), est(1200), overlap_estimate(F.lit(950), 100, F.lit(False))) == (95, 100, 0)


@pytest.mark.parametrize(
    "url, normal",
    [
        ("http://h.example.com/fr/825?page=2&ref=x#top", "http://h.example.com/fr/825?page=2"),
        ("HTTPS://Ex.COM:443", "https://ex.com/"),
        ("http://ex.com:8080/a/../b/./c?utm_source=x", "http://ex.com:8080/b/c"),
        ("http://ex.com/é x", "http://ex.com/%C3%A9%20x"),
        ("not a url", "not a url"),
    ],
)
def test_normal_urls(spark, url, normal):
    assert one(spark, U.drop_params(U.normalize(F.lit(url))))[0] == normal


def test_links_resolve_against_the_page(spark):
    base = F.lit("https://ex.com/docs/intro?x=1")
    hrefs = ["/a", "b", "../c", "?y=2", "#z", "//cdn.ex.com/i", "http://o.org/p", "mailto:x@y.z", ""]
    got = one(spark, *[U.normalize(U.absolute(F.lit(h), base)) for h in hrefs])
    assert got == (
        "https://ex.com/a", "https://ex.com/docs/b", "https://ex.com/c", "https://ex.com/docs/intro?y=2",
        "https://ex.com/docs/intro?x=1", "https://cdn.ex.com/i", "http://o.org/p", None, "https://ex.com/docs/intro?x=1",
    )
    assert one(spark, U.with_https(F.lit("//cdn.example.com/a.png")))[0] == "https://cdn.example.com/a.png"


@pytest.mark.parametrize(
    "glob, url, hit",
    [
        ("https://d.org/3/**", "https://d.org/3/tutorial/x.html", True),
        ("https://d.org/3/**", "https://d.org/3/", True),
        ("https://d.org/3/**", "https://d.org/3", False),
        ("https://d.org/3/**", "https://d.org/2/x", False),
        ("https://d.org/*", "https://d.org/a/b", False),
        ("https://d.org/*", "https://d.org/.hidden", False),
        ("**/*.pdf", "https://d.org/a/b.pdf", True),
        ("**/*.pdf", "https://d.org/a/b.pdfx", False),
        ("https://{a,b}.org/?", "https://b.org/x", True),
        ("https://{a,b}.org/?", "https://c.org/x", False),
        ("https://d.org/[a-c]*/x", "https://d.org/bcd/x", True),
        ("**", "https://d.org/a", True),
    ],
)
def test_globs(spark, glob, url, hit):
    assert one(spark, U.matches_any_glob(F.lit(url), [glob]))[0] is hit


def test_admission_order(spark):
    def decide(url, depth):
        return U.admission(F.lit(url), F.lit(depth), 3, ["https://in.org/**"], ["**/*.pdf"])

    got = one(spark, decide("https://in.org/a.pdf", 3), decide("https://in.org/a.pdf", 1), decide("https://x.org/", 1), decide("https://in.org/a", 1))
    assert got == ("depth_exceeded", "excluded_pattern", "not_included", "allowed")


def test_entities_attributes_and_titles(spark):
    got = one(
        spark,
        H.decode_entities(F.lit("a &amp; b &#233;&#x20AC; &nope; & &lt;x&gt; &#0;")),
        H.attribute(F.lit("<a data-href=no class='k' href = \"x?a=1&amp;b=2\">"), "href"),
        H.attribute(F.lit("<img src=/i.png alt>"), "src"),
        H.attribute(F.lit("<img src=/i.png>"), "title"),
        H.page_title(F.lit("<title> A\n&amp; B </title>"), F.lit("http://x.org/")),
        H.page_title(F.lit("<p>"), F.lit("http://X.org/")),
        H.page_title(F.lit("<p>"), F.lit("?")),
    )
    assert got == ("a & b é€ &nope; & <x> �", "x?a=1&b=2", "/i.png", None, "A & B", "x.org", "Unknown")


def test_markdown_text_and_code_language(spark):
    got = one(
        spark, M.to_plain_text(F.lit("![alt](u) and [t](v)")),
        M.code_language(F.lit("hl language-Rust"), F.lit("")), M.code_language(F.lit(""), F.lit("import os")),
        M.code_language(F.lit("a b"), F.lit("x")),
    )
    assert got == ("!alt and t", "rust", "python", "")


def test_failures_and_durations(spark):
    messages = ["ECONNRESET", "Navigation timeout", "Too many requests", "boom", "network timeout", None]
    got = one(spark, *[X.category(F.lit(m)) for m in messages])
    assert got == ("network", "timeout", "rate_limit", "unknown", "network", "unknown")
    assert one(spark, *[N.duration_text(F.lit(ms)) for ms in (3_661_000, 61_000, 5_400)]) == ("1h 1m 1s", "1m 1s", "5s")


@pytest.mark.parametrize(
    "bad",
    [
        {"crawl_depth": 0}, {"crawl_depth": 11}, {"chunk_size": 99}, {"chunk_overlap": 501}, {"max_pages": 0},
        {"chunk_size": 100, "chunk_overlap": 100}, {"separators": ()}, {"include_globs": ("docs/**",)}, {"chunk_size": 1.5},
    ],
)
def test_parameter_ranges(bad):
    with pytest.raises(ParameterError):
        PageJobParams(**bad)


def test_references_with_any_number_of_zeros(spark):
    cases = {"&#0000000065;": "A", "&#x0000000041;": "A", "&#65;&#X41;": "AA", "&#0;": "�", "&#x0;": "�", "&#99999999;": "&#99999999;"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", H.decode_entities("t")).collect()} == cases


def test_very_long_paths_keep_their_end(spark):
    path = "/a" * 600_000 + "/end"
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(U.resolve_dots(F.col("p"))).first()[0] == path
