"""Main text of pages by minimum-cut labelling.

A page becomes text blocks in page order. A classifier's costs of calling a block content or boilerplate are
its capacities to the two terminals. Neighbouring blocks are joined by smoothness edges, the stronger
the closer they stand in the element tree, and so is each block with the next one of the same parent
element. The minimum cut labels all blocks of a page at once; blocks on the content side are the text.

The classifier is a logistic regression over what a block looks like (length, links, punctuation, tag,
place). It learns from the pages themselves: from a bounded sample of ``TRAINING_PAGES`` pages, drawn by a
hash, and at most ``TRAINING_BLOCKS`` blocks of each, those blocks count as labelled whose ancestors
speak for a side (``article`` and ``main`` against ``nav``, ``footer``, ``aside``, ``form`` and elements named as
such; in a name of several words, such as ``main-menu`` or ``article-comments``, the part against wins). These
ancestors are no inputs of the regression; where they are there, they add ``TEXT_COST`` or ``NOT_TEXT_COST`` to
their side of the cut. ``TEXT_COST`` is less than the most the regression can say, and neighbours
settle what is close, so lists of links in an element for text may go. ``NOT_TEXT_COST`` is a little more than
they reach for a single block, as adverts and comments amid a text often read like text; blocks without
ancestors that speak, and all others, are left to the cut. Every page is labelled, whole.

Null html counts as empty and gives empty text. Null and repeated ids keep their rows. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import portions
from pagewright.llm.html_blocks import Block, Element, blocks_of
from pagewright.llm.max_flow import CutGraph
from pagewright.llm.sampling import drawn

TRAINING_PAGES, TRAINING_BLOCKS = 1000, 60
#: Costs in logits; a smoothness edge is halved for each step between the elements that hold two blocks.
TEXT_COST, NOT_TEXT_COST, MOST_EVIDENCE, SMOOTHNESS, SIBLING = 2.75, 4.25, 3.0, 1.0, 0.5
#: Whole-number capacities per logit.
UNIT = 1000

# Names of elements, and words in their class, id and role, that mark a side.
NOT_TEXT_TAGS = frozenset("nav footer aside form menu dialog select button option fieldset search head".split())
TEXT_TAGS = frozenset("article main".split())
NOT_TEXT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "subscribe subscription newsletter signup login form search social share sharing related recommended recommendations "
    "comment comments respond reply replies disqus discussion widget pagination pager toolbar copyright legal contentinfo "
    "complementary".split()
)
TEXT_WORDS = frozenset("article content main post entry story".split())
#: Names with these say something about another element.
ABOUT_OTHERS = frozenset("has with no without not".split())

FEATURES = 12


def side_of_name(words: frozenset[str]) -> int:
    """What one name says: 1 for content, -1 for boilerplate, 0 for neither."""
    if words & ABOUT_OTHERS:
        return 0
    against, text = words & NOT_TEXT_WORDS, words & TEXT_WORDS
    if against:
        # The header of an article holds its title.
        return 1 if text and against == {"header"} else -1
    return 1 if text else 0


def own_side(x: Element) -> int:
    """What the tag and the names of an element say; what is against content wins."""
    if x.tag in ("html", "body"):
        return 0
    said = [side_of_name(words) for words in x.names]
    if x.tag in NOT_TEXT_TAGS or -1 in said:
        return -1
    return 1 if x.tag in TEXT_TAGS or 1 in said else 0


def side_of(element: int, elements: list[Element], known: dict[int, int]) -> int:
    """1 if the ancestors say content, -1 if any says boilerplate, 0 if none says anything."""
    path = []
    while element and element not in known:
        path.append(element)
        element = elements[element].parent
    side = known.get(element, 0)
    for e in reversed(path):
        x = elements[e]
        if side >= 0:
            # A header inside an article holds its title.
            side = -1 if x.tag == "header" and side == 0 else own_side(x) or side
        known[e] = side
    return side


def features(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """What each block looks like, one row per block."""
    out = np.zeros((len(blocks), FEATURES))
    n = len(blocks)
    for i, b in enumerate(blocks):
        text, tag = b.text, elements[b.element].tag
        words = text.count(" ") + 1
        marks = sum(map(text.count, ".,;:!?"))
        out[i] = (
            np.log1p(len(text)), np.log1p(words), b.link_chars / len(text), min(2.0, marks / words), text[-1] in ".!?:;\"'”»)",
            len(text) / words / 10, tag == "p", tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag in ("li", "td", "th", "dd", "dt"),
            tag in ("div", "section", "body", ""), i / n, sum(map(text.count, "©|›»•")) > 0,
        )
    return out


class BlockModel:
    """Weights of the regression; before training all blocks are undecided but for length and links."""

    def __init__(self):
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.weights[[0, 2, 3]] = -1.2, 0.6, -4.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        if not 0 < y.sum() < len(y):
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both sides weigh alike
        w = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
            w += np.clip(np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1.0 * w), -2, 2)
        self.weights = w

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -MOST_EVIDENCE, MOST_EVIDENCE)


def _steps(a: int, b: int, elements: list[Element]) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def label(blocks: list[Block], elements: list[Element], model: BlockModel) -> list[bool]:
    """Per block whether the minimum cut leaves it on the content side."""
    if not blocks:
        return []
    known: dict[int, int] = {}
    sides = [side_of(b.element, elements, known) for b in blocks]
    hint = np.select([np.array(sides) > 0, np.array(sides) < 0], [TEXT_COST, -NOT_TEXT_COST], 0.0)
    cost = model.evidence(features(blocks, elements)) + hint
    # A block stands in its parent element, or in its own where that says what it is.
    holders = [b.element if own_side(elements[b.element]) else elements[b.element].parent for b in blocks]
    graph = CutGraph(len(blocks))
    latest: dict[int, int] = {}
    for i, b in enumerate(blocks):
        units = round(float(cost[i]) * UNIT)
        graph.terminal(i, max(units, 0), max(-units, 0))
        parent = elements[b.element].parent
        if i:
            steps = _steps(holders[i], holders[i - 1], elements)
            graph.smooth(i - 1, i, round(SMOOTHNESS * UNIT * 0.5**steps))
        if latest.get(parent, i - 1) != i - 1:
            graph.smooth(latest[parent], i, round(SIBLING * UNIT))
        latest[parent] = i
    return graph.source_side()


def main_text(html: str, model: BlockModel) -> str:
    blocks, elements = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, elements, model)) if keep)


def train(pages: DataFrame) -> BlockModel:
    """A model from a bounded sample of ``pages`` (html)."""
    stored = pages.select("page_id", "html").where("html IS NOT NULL")
    sample = drawn(stored, TRAINING_PAGES, "pages", of=pages.count()).select("html")

    def measure(batches):
        for b in portions(batches, 100):
            rows, sides = [], []
            for html in b.column(0).to_pylist():
                blocks, elements = blocks_of(html)
                known: dict[int, int] = {}
                told = [side_of(x.element, elements, known) for x in blocks]
                for row, side in list(zip(features(blocks, elements), told))[:: max(1, -(-len(blocks) // TRAINING_BLOCKS))]:
                    if side:
                        rows.append(row.tolist())
                        sides.append(side)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(sides, pa.int32())], ["x", "side"])

    rows = sorted((tuple(r.x), r.side) for r in sample.mapInArrow(measure, "x array<double>, side int").collect())
    model = BlockModel()
    if rows:
        model.fit(np.array([r[0] for r in rows]), np.array([r[1] > 0 for r in rows], float))
    return model


def extract(pages: DataFrame, model: BlockModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""
    model = model or train(pages)

    def run(batches):
        for b in portions(batches, 200):
            texts = [main_text(html or "", model) for html in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
