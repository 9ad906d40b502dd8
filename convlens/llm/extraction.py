"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node that is content or not. Parent-child potentials connect the nodes
of the document tree, node potentials come from the tag, the words of class and id, the amount of
text and the share of links below the node. All of them are estimated from labelled pages (see
``labelled_pages``). Sum-product messages run once up and once down the tree and give each node its
exact marginal; blocks of text whose element is content with probability 1/2 or more make up the
text, in page order.

A page is read, judged and written in one task; nothing is shuffled.

Defined results: a null or empty page, or one without content, gives an empty text; white space
inside a block (no-break spaces too) becomes one space; a line break counts as white space; pages of
any length are read whole; text without any markup is one block of the root, which is no content;
a null id or url is passed through; repeated rows give repeated rows; an empty table gives none;
only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm.htmltree import INLINE, RAW, Page, parse
from convlens.llm.labelled_pages import labelled_pages

_SPACE = re.compile(r"\s+")
SECTIONS = frozenset("section div td body table tbody tr center #root html".split())
APART = frozenset("nav aside footer header form menu fieldset dialog select button label head template".split())


def _kind(tag: str) -> str:
    if tag in INLINE and tag not in APART:
        return "inline"
    if tag in ("article", "main"):
        return "article"
    return "section" if tag in SECTIONS else "apart" if tag in APART else "block"


def features(page: Page) -> list[list[tuple[str, str]]]:
    """What each node shows: tag, words of class and id, text below it, links among that text."""
    n = len(page.tag)
    text, links = [0] * n, [0] * n
    for node, piece in page.pieces:
        if piece:
            text[node] += len(piece) - piece.count(" ")
    for i, tag in enumerate(page.tag):
        if tag == "a":
            links[i] = 1
    linked = [0] * n
    for i in range(n - 1, 0, -1):
        parent = page.parent[i]
        if page.tag[i] == "a":
            linked[i] = text[i]
        text[parent] += text[i]
        linked[parent] += linked[i]
    out = []
    for i in range(n):
        share = linked[i] / text[i] if text[i] else 0.0
        shown = [
            ("tag", page.tag[i]),
            ("text", str(min(5, text[i].bit_length() // 2))),
            ("links", "none" if not linked[i] else "few" if share < 0.3 else "half" if share < 0.7 else "most"),
            ("hidden", str(page.hidden[i])),
        ]
        shown += [("name", w) for w in dict.fromkeys(page.names[i])]
        out.append(shown)
    return out


@dataclass(frozen=True)
class TreeModel:
    """evidence[feature]: log p(feature | content) / p(feature | other); moves[kind][a][b]: probability
    that a child of that kind is b (1: content) under a parent that is a."""

    evidence: dict[tuple[str, str], float]
    moves: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def marginals(self, page: Page) -> list[float]:
        """Probability of each node to be content, by one sweep up and one sweep down."""
        n = len(page.tag)
        known = self.evidence.get
        odds = [sum([known(f, 0.0) for f in shown]) for shown in features(page)]
        local = [(1.0, math.exp(max(-30.0, min(30.0, o)))) for o in odds]
        below0, below1 = [x[0] for x in local], [x[1] for x in local]
        up0, up1 = [1.0] * n, [1.0] * n  # message of a node to its parent
        kinds = [_kind(t) for t in page.tag]
        for i in range(n - 1, 0, -1):
            (m00, m01), (m10, m11) = self.moves[kinds[i]]
            a = m00 * below0[i] + m01 * below1[i]
            b = m10 * below0[i] + m11 * below1[i]
            size = a + b
            up0[i], up1[i] = a / size, b / size
            parent = page.parent[i]
            c, d = below0[parent] * up0[i], below1[parent] * up1[i]
            size = c + d
            below0[parent], below1[parent] = c / size, d / size
        content = [0.0] * n  # the root holds the page and is no content itself
        for i in range(1, n):
            parent = page.parent[i]
            p = content[parent]
            # the parent's belief without what this node told it
            q0, q1 = (1 - p) / up0[i], p / up1[i]
            (m00, m01), (m10, m11) = self.moves[kinds[i]]
            a = (q0 * m00 + q1 * m10) * below0[i]
            b = (q0 * m01 + q1 * m11) * below1[i]
            content[i] = b / (a + b)
        return content


def train(pages: list[str], smooth: float = 0.5) -> TreeModel:
    """Counts over labelled pages. A feature weighs by how often it shows on nodes that are content or
    not; inline nodes follow their parents and show nothing of their own."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]
    moves: dict[str, list[list[float]]] = defaultdict(lambda: [[smooth, smooth], [smooth, smooth]])
    values: dict[str, set[str]] = defaultdict(set)
    for text in pages:
        page = parse(text)
        label = [0] * len(page.tag)
        for i in range(1, len(page.tag)):
            label[i] = int(page.main[i] or (label[page.parent[i]] and not page.other[i]))
            moves[_kind(page.tag[i])][label[page.parent[i]]][label[i]] += 1
        for i, shown in enumerate(features(page)):
            if i and _kind(page.tag[i]) != "inline":
                total[label[i]] += 1
                for f in shown:
                    seen[label[i]][f] += 1
                    values[f[0]].add(f[1])
    evidence = {}
    for f in {*seen[0], *seen[1]}:
        spread = 2 if f[0] == "name" else len(values[f[0]])
        ratio = [(seen[c][f] + smooth) / (total[c] + smooth * spread) for c in (0, 1)]
        evidence[f] = math.log(ratio[1] / ratio[0])
    table = {k: tuple(tuple(x / sum(row) for x in row) for row in moves[k]) for k in ("article", "section", "apart", "block", "inline")}
    return TreeModel(evidence, table)


def main_text(html: str | None, model: TreeModel, threshold: float = 0.5) -> str:
    if not html:
        return ""
    page = parse(html)
    content = model.marginals(page)
    block = list(range(len(page.tag)))  # the nearest element that is no inline one
    for i in range(1, len(block)):
        if page.tag[i] in INLINE:
            block[i] = block[page.parent[i]]
    blocks: list[str] = []
    own, pieces = -1, []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            blocks.append(text)
        pieces.clear()

    for node, piece in page.pieces:
        if piece is None or block[node] != own:
            close()
            own = block[node]
        if piece is not None and content[own] >= threshold and page.tag[own] not in RAW:
            pieces.append(piece)
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame, model: TreeModel, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (ident, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x, model) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    narrow = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return narrow.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled_pages()))
