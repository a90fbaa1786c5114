"""Minimum-cut labelling of page blocks."""

import random

import pytest
from pagewright.llm.html_blocks import blocks_of
from pagewright.llm.main_text import BlockModel, extract, main_text
from pagewright.llm.max_flow import CutGraph

LONG = "This is a sentence of the story, and it goes on for a while. Another one follows it here."


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 7)
        graph, ends, edges = CutGraph(n), [], []
        for i in range(n):
            ends.append((rng.randint(0, 9), rng.randint(0, 9)))
            graph.terminal(i, *ends[-1])
        for _ in range(rng.randint(0, 10)):
            a, b, w = rng.randrange(n), rng.randrange(n), rng.randint(1, 6)
            if a != b:
                graph.smooth(a, b, w)
                edges.append((a, b, w))

        def cost(side, ends=ends, edges=edges):
            return sum(e[1] if s else e[0] for s, e in zip(side, ends)) + sum(w for a, b, w in edges if side[a] != side[b])

        assert cost(graph.source_side()) == min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain   words\n only & more, of a sentence that is long enough to be text, surely.", None),
        (f"<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{LONG}<p>x<br>y</article><footer>c</footer>", f"A & B\n{LONG}\nx y"),
        (f"<main><p>{LONG}</p><aside>{LONG}</aside><div class='comments'><p>{LONG}</p></div></main>", LONG),
        (f"<div class=cookie-notice>{LONG}</div><article>{LONG}<form><p>Mail</p></form><script>if (a < b) '</p>'</script></article>", LONG),
        (f"<header>{LONG}</header><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='advert'>{LONG}</div><p>Be.</p></article>", f"{LONG}\nBe."),
        (f"<article><p>a<b>b</b>c&nbsp;d &#65;&lt;i&gt;</p><!-- <p>no</p> --><p>{LONG}", f"abc d A<i>\n{LONG}"),
        ("<nav><ul>" + "<li><a href=/x>x</a>" * 30 + "</ul></nav>", ""),
        (f"<article><p title='a > b'>{LONG}</p><p data-x=\"<p>\">1 < 2</p></article>", f"{LONG}\n1 < 2"),
    ],
)
def test_pages(html, want):
    got = main_text(html, BlockModel())
    assert got == want if want is not None else got


#: Boilerplate by a name of several words, or by one name of several.
AROUND = [
    '<div class="main-menu"><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div>',
    f'<div id="main-sidebar"><p>{LONG}</p></div>',
    f'<section class="article-comments"><p>{LONG}</p><p>{LONG}</p></section>',
    f'<div class="siteNavigation mainNav"><p>{LONG}</p></div>',
    f'<div class="content cookie-banner">{LONG}</div>',
    f'<div role="complementary" class="story">{LONG}</div>',
    f'<div id="post-footer"><p>{LONG}</p></div>',
]
INSIDE = [
    f'<div class="post-comments"><p>{LONG}</p></div>',
    f'<div class="content-ad"><p>{LONG}</p></div>',
    '<div class="entry-share"><a href=/s>Share</a> <a href=/t>Send</a></div>',
    f'<div class="story_promo"><div><p>{LONG}</p></div></div>',
    f'<article class="comment"><p>{LONG}</p></article>',
    f'<div class="relatedPosts">{LONG}</div>',
    f'<div id=newsletter-signup><p>{LONG}</p></div>',
    f'<ul class="pagination"><li>{LONG}</ul>',
]
KEPT = ['class="post-content"', 'class="article-header"', 'id=main', 'class="content has-sidebar"', 'class="entry no-comments"']


@pytest.mark.parametrize("part", AROUND)
def test_compound_names_around_the_article(part):
    for page in (part + f"<article><h1>T</h1><p>{LONG}</p></article>", f"<main><article><h1>T</h1><p>{LONG}</p></article></main>" + part):
        assert main_text(page, BlockModel()) == f"T\n{LONG}"


@pytest.mark.parametrize("part", INSIDE)
def test_compound_names_inside_the_article(part):
    assert main_text(f"<article><p>{LONG}</p>{part}<p>{LONG} End.</p></article>", BlockModel()) == f"{LONG}\n{LONG} End."


@pytest.mark.parametrize("name", KEPT)
def test_names_that_do_not_speak_against_text(name):
    assert main_text(f"<body><div {name}><h2>Title</h2><p>{LONG}</p></div></body>", BlockModel()) == f"Title\n{LONG}"


def test_the_cut_outvotes_hints():
    """A list of links inside an element for content goes with the links around it, and stays amid text."""
    links = "".join(f"<li><a href=/{i}>Link {i}</a>" for i in range(12))
    page = f"<main><p>{LONG}</p><p>{LONG}</p></main><main><ul>{links}</ul></main><nav><ul>{links}</ul></nav>"
    assert main_text(page, BlockModel()) == f"{LONG}\n{LONG}"
    assert main_text(f"<main><p>{LONG}</p><p><a href=/x>Link</a></p><p>{LONG}</p></main>", BlockModel()) == f"{LONG}\nLink\n{LONG}"


def test_page_without_hints():
    """No telling elements or names: length and links decide, and neighbours agree."""
    html = "<div><div>" + "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(8)) + "</div><div>"
    html += "".join(f"<p>{LONG}</p>" for _ in range(3)) + "<p>Short.</p>" + f"<p>{LONG}</p></div></div>"
    assert main_text(html, BlockModel()) == "\n".join([LONG] * 3 + ["Short.", LONG])


def test_long_and_deep_pages():
    blocks, _ = blocks_of("<div>" * 3000 + "x" + "<p>y" * 20_000)
    assert len(blocks) == 20_001
    assert main_text("<article>" + f"<p>{LONG}" * 5000, BlockModel()).count("\n") == 4999
    assert blocks_of("<a href='" * 2000)[0]


def test_table_of_odd_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</article>", "x", "y"), (2, None, None, "x", "y"), (None, "u", "", "x", "y"), (1, "u", "<p", "x", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted((tuple(r) for r in extract(table).collect()), key=str)
    assert (1, "u", LONG, len(LONG)) in got and (2, None, "", 0) in got and (None, "u", "", 0) in got and len(got) == 4
    assert extract(table.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark):
    """The paragraphs of the article, for every page."""
    import html as h
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = (" ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(x for x in parts if x)
