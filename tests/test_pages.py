"""Markdown rendering, main content and the page job on small hand-made pages."""

import re

import pytest

from pagewright.operators.content import by_page, extract_content, laid_out
from pagewright.operators.html_tokens import pair_tags, tokenize
from pagewright.operators.markdown import line_prefixes, render_markdown, token_flags
from pagewright.plans.pages import page_content, page_results

MARKDOWN = {
    "<h1>Title</h1><p>Hello <b>bold </b>and <em> it</em> &amp; more_x * [z]</p><p>two<br>lines</p>":
        "# Title\n\nHello **bold** and *it* & more\\_x \\* \\[z\\]\n\ntwo  \nlines",
    "<ul><li>one</li><li>two<ul><li>in1</li><li>in2</li></ul></li><li><p>three</p></li></ul><p>after</p>":
        "- one\n- two\n-     - in1\n-     - in2\n- three\n\nafter",
    "<ol><li>a</li><li>b</li></ol><blockquote><p>q1</p></blockquote><blockquote>plain</blockquote>":
        "1. a\n2. b\n\n>\n> q1\n>\n\n> plain".replace(">\n> q1\n>", ">\n>\n> q1\n>\n>"),
    "<pre class='x'><code class=\"c\">def f(x): return 1\n</code></pre><p>use <code>a_b *c*</code> ok</p>":
        "```python\ndef f(x): return 1\n\n```\n\nuse `a_b *c*` ok",
    "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>":
        "| A | B |\n| --- | --- |\n| 1 | 2 |",
    "<table><tr><td>1</td><td>2</td></tr></table>": "| 1 | 2 |",
    "<p><a href='//cdn.example.com/x' title=\"T\">t</a> <a>none</a> <img src=/i.png alt='al t' title=q> <img alt=z></p><nav>no</nav><hr>":
        '[t](https://cdn.example.com/x "T") none ![al t](/i.png "q")\n\n---',
    "<p><b>unclosed<p>next &#8364; &lt;tag&gt; 1 < 2</p><script>x()</script><style>y":
        "unclosed\n\nnext € <tag> 1 < 2",
    "<p>a</p><p>1. x</p><p>- y</p>": "a\n\n1\\. x\n\n\\- y",
    "": "",
}


def test_markdown_cases(spark):
    cases = list(MARKDOWN.items())
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)] + [(99, None)], "page_id long, content_html string")
    got = {r.page_id: r.markdown for r in render_markdown(df).collect()}
    assert len(got) == len(cases) + 1 and got[99] == ""
    for i, (html, expected) in enumerate(cases):
        assert got[i] == expected, html


def test_tags_pair_by_level(spark):
    html = "</div><div>1<div>2</div><p>x<div>3</div></div><div>open"
    rows = pair_tags(tokenize(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("pos").collect()
    mates = {r.pos: r.mate for r in rows if r.tag == "div"}
    assert mates == {0: None, 1: 11, 3: 5, 5: 3, 8: 10, 10: 8, 11: 1, 12: None}


LONG = "Sentence with some words, and a comma. " * 30
PAGES = [
    (1, "http://x.org/1", f"<html><head><title>T1</title></head><body><nav>{'menu ' * 200}</nav><div class='side'><a href=/a>{'link ' * 100}</a></div><article><p>{LONG}</p><p>{LONG}</p></article></body></html>"),
    (2, "http://x.org/2", None),
    (3, "http://x.org/3", "   "),
    (4, "http://x.org/4", f"<body><nav>{LONG}</nav>"),
    (5, "nonsense", f"<body><div><section><p><b>{LONG}<p>{LONG}</section></div>"),
    (6, "http://x.org/6", f"<body><div class='x post-content'><span>{'w ' * 300}</span></div><p>{'a b c ' * 20}"),
    (7, "http://x.org/7", "<body><p>short</p></body>" + "<!-- " + "x" * 200 + " -->"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_main_content_picks_text_over_navigation(spark, pages):
    got = {r.page_id: r for r in extract_content(by_page(pages)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    assert got[1].method == "readability" and got[1].content_html.startswith("<p>Sentence") and "menu" not in got[1].content_html
    assert got[1].title == "T1" and got[5].title == "Unknown" and got[4].title == "x.org"
    assert got[5].method == "readability" and got[5].content_text.startswith("Sentence")
    # text in navigation only: no primary region, the body is the best selector
    assert got[4].method == "fallback-body" and got[4].fallback_used
    assert got[2].content_html is None and got[3].content_html is None


def test_page_job_keeps_every_page(spark, pages):
    got = {r.url + str(r.title): r for r in page_results(pages).collect()}
    by_url = {r.url: r for r in got.values()}
    assert len(by_url) == 7
    ok = by_url["http://x.org/1"]
    assert ok.status == "success" and ok.total_chunks == len(ok.chunks) > 1
    assert [c.chunk_index for c in ok.chunks] == list(range(ok.total_chunks))
    assert sum(c.tokens for c in ok.chunks) == ok.total_tokens
    assert ok.chunks[0].metadata.source.domain == "x.org"
    failed = by_url["http://x.org/2"]
    assert failed.status == "extraction_failed" and failed.chunks == [] and "must be a string" in failed.error
    assert by_url["http://x.org/7"].error_stage == "parsing"
    # the fallback holds text, but Markdown drops navigation, so nothing is left
    assert by_url["http://x.org/4"].error == "Final result has no Markdown content"


def nodes_of(spark, df, kind):
    """The nodes of a plan whose name begins with ``kind``, as it stands before it runs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stack, found = [df.select("*")._jdf.queryExecution().executedPlan()], []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    while stack:
        node = stack.pop()
        if node.nodeName().startswith(kind):
            found.append(node)
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


#: Short texts that may go through a sort: names of tags and kinds, marks of one character.
NARROW = {"tag", "kind", "role", "mark", "_extract_mark"}


def wide_columns(spark, df):
    """Columns below a Sort that hold text other than names."""
    out = set()
    for node in nodes_of(spark, df, "Sort"):
        for i in range(node.output().size()):
            a = node.output().apply(i)
            fields = re.sub(r"mark:string|role:string|kind:string|tag:string", "", a.dataType().simpleString())
            if a.name() not in NARROW and "string" in fields and not re.match(r"_(we|w|next|prev)", a.name()):
                out.add(f"{a.name()} {fields}")
    return out


def test_page_job_sorts_no_text_and_moves_pages_once(spark, pages):
    laid = laid_out(pages)
    content = extract_content(laid)
    assert nodes_of(spark, laid, "Exchange") == [] and nodes_of(spark, content, "Exchange") == []
    assert nodes_of(spark, content, "SortMergeJoin") == [] and len(nodes_of(spark, content, "ShuffledHashJoin")) == 1
    assert wide_columns(spark, content) == set() and len(nodes_of(spark, content, "Sort")) <= 6
    flags = token_flags(laid, "html")
    assert wide_columns(spark, flags) == set() and nodes_of(spark, flags, "Exchange") == []
    prefixes = line_prefixes(laid.withColumnRenamed("html", "md"))
    assert wide_columns(spark, prefixes) == set() and nodes_of(spark, prefixes, "Exchange") == []
    whole = page_content(pages)
    assert nodes_of(spark, whole, "Exchange") == [] and wide_columns(spark, whole) == set()
    results = page_results(pages)
    assert len(nodes_of(spark, results, "Sort")) <= 6 and wide_columns(spark, results) == set()
    assert not nodes_of(spark, whole, "ArrowEvalPython")


def test_a_large_page_keeps_its_order(spark):
    items = "".join(f"<li>item {i} of a long list, with <a href='/{i}'>a link</a></li>" for i in range(3000))
    html = f"<html><body><article><p>{LONG}</p><ul>{items}</ul><blockquote><ol><li>x</li></ol></blockquote></article></body></html>"
    (row,) = page_content(spark.createDataFrame([(1, "http://x.org/", html)], "page_id long, url string, html string")).collect()
    lines = [x for x in row.markdown.split("\n") if x.startswith("- item")]
    assert lines == [f"- item {i} of a long list, with [a link](/{i})" for i in range(3000)]
    assert "> 1. x" in row.markdown.split("\n")


def test_pages_that_share_an_id_or_have_none(spark):
    def page(name):
        return f"<html><head><title>{name}</title></head><body><article><p>{name}. {LONG}</p></article></body></html>"

    rows = [(1, "http://x.org/x", page("Alpha")), (1, "http://x.org/y", page("Beta")), (2, "http://x.org/z", page("Gamma"))]
    rows += [(None, "http://x.org/n", page("Delta")), (None, "http://x.org/m", page("Epsilon")), (2, "http://x.org/z", page("Gamma"))]
    rows += [(9, "http://x.org/s", "<p>tiny</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_results(df).collect()
    assert sorted((r.url, r.title, r.status) for r in got) == sorted(
        (u, h.split("title>")[1][:-2] if "title>" in h else "x.org", "success" if len(h) > 100 else "extraction_failed") for _, u, h in rows
    )
    for r in got:
        if r.chunks:
            assert r.chunks[0].content.startswith(f"{r.title}. Sentence")
    short = next(r for r in got if r.url.endswith("/s"))
    assert (short.error_stage, short.error) == ("extraction", "Page content is empty or too short")
    ids = sorted((str(r.page_id), r.title) for r in page_content(df).collect())
    assert ids == sorted((str(i), t) for (i, _, _), t in zip(rows, ["Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Gamma", "x.org"]))


def test_a_tag_with_very_many_attributes_is_one_token(spark):
    many = " ".join(f'data-a{i}="x > {i}"' for i in range(5000))
    df = spark.createDataFrame([(1, f"<p {many}>text</p>")], "page_id long, html string")
    assert [r.raw for r in tokenize(df).orderBy("pos").collect()] == [f"<p {many}>", "text", "</p>"]
