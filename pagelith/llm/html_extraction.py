"""HTML extraction: boosted trees over DOM-node features with hierarchical decoding.

Every block element gets features of its subtree, its attributes, its place and its
siblings. The trees give the odds that it holds main text. Decoding picks the set of
elements of the greatest total log-odds in which no element is kept under one that is
not, so ancestors and descendants never contradict each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelith.llm import trees
from pagelith.llm.html_pages import NAMES, Pages
from pagelith.llm.html_tree import Node, nodes_of, parse, runs

TRAINING_PAGES, SEED = 500, 20240501
TAG_GROUPS = (
    ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog"), ("article",), ("main",), ("section",), ("div",), ("p",),
    ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"),
    ("blockquote", "pre", "figure", "figcaption"), ("ins",),
)
TAG_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
KINDS = [k for k in NAMES if k != "plain"]
TOKENS: dict[str, set[int]] = {}
for _i, _k in enumerate(KINDS):
    for _name in NAMES[_k]:
        for _t in re.split(r"[-_]", _name):
            if len(_t) > 1 and _t not in ("site", "main", "page", "col", "right", "more", "top", "bottom", "reader", "body", "list", "post"):
                TOKENS.setdefault(_t, set()).add(_i)
TOKENS.update({"navigation": {0}, "banner": {1, 5}, "contentinfo": {2}, "complementary": {3}, "main": {KINDS.index("content")}, "post": {KINDS.index("content")}})
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
SEMANTIC = {"nav": 0, "menu": 0, "footer": 2, "aside": 3, "form": 6, "dialog": 4, "article": 9, "main": 9}
CONTENT = KINDS.index("content")


@lru_cache(maxsize=50_000)
def kinds_of(value: str) -> tuple[int, ...]:
    found: set[int] = set()
    for t in SPLIT.split(value):
        t = t.lower()
        found |= TOKENS.get(t, TOKENS.get(t.removesuffix("s"), set()))
    return tuple(sorted(found))


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node, parents first."""
    n, k = len(nodes), len(KINDS)
    own = np.zeros((n, 8))  # chars, link chars, words, stops, controls, links, blocks, sentences' ends
    marks = np.zeros((n, k))
    tag = np.full(n, -1)
    parent = np.zeros(n, np.int64)
    place = np.zeros((n, 5))
    hidden = np.zeros(n)
    for i, x in enumerate(nodes):
        text = "".join(s for _, s in x.parts)
        if text and not text.isspace():
            words = len(text.split())
            own[i] = (len(text.strip()), x.link_chars, words, text.count(".") + text.count("!") + text.count("?"), x.controls, x.links, 1, text.count(","))
        else:
            own[i, 4], own[i, 5] = x.controls, x.links
        tag[i] = TAG_OF.get(x.tag, -1)
        if x.parent is not None:
            parent[i] = x.parent.order
            siblings = x.parent.children
            place[i] = (place[parent[i], 0] + 1, len(siblings), 0, 0, i / n)
        if x.attributes:
            value = " ".join(x.attributes.get(a, "") for a in ("class", "id", "role", "itemprop", "aria-label"))
            marks[i, list(kinds_of(value))] = 1
            style = x.attributes.get("style", "").replace(" ", "")
            hidden[i] = "hidden" in x.attributes or "display:none" in style or x.attributes.get("aria-hidden") == "true"
        same = {}
        for j, c in enumerate(x.children):
            same[c.tag] = same.get(c.tag, 0) + 1
        for j, c in enumerate(x.children):
            place[c.order, 2], place[c.order, 3] = j / max(1, len(x.children) - 1), same[c.tag]
        if x.tag in SEMANTIC:
            marks[i, SEMANTIC[x.tag]] = max(marks[i, SEMANTIC[x.tag]], 0.5)
    under = own.copy()
    count = np.ones(n)
    for i in range(n - 1, 0, -1):
        under[parent[i]] += under[i]
        count[parent[i]] += count[i]
    above = np.zeros((n, k))  # least distance-weighted mark of an ancestor
    bad_above = np.zeros(n)
    for i in range(1, n):
        above[i] = np.maximum(above[parent[i]] * 0.9, marks[parent[i]])
        bad_above[i] = max(bad_above[parent[i]], hidden[parent[i]])
    chars = np.maximum(under[:, 0], 1)
    total = max(1.0, under[0, 0])
    one_hot = np.zeros((n, len(TAG_GROUPS)))
    rows = np.flatnonzero(tag >= 0)
    one_hot[rows, tag[rows]] = 1
    return np.column_stack([
        one_hot, marks, above, hidden, bad_above, np.log1p(under[:, 0]), under[:, 0] / total, under[:, 1] / chars, np.log1p(under[:, 2]),
        under[:, 3] / np.maximum(under[:, 2], 1), under[:, 7] / np.maximum(under[:, 2], 1), under[:, 4], under[:, 5] / count, under[:, 0] / count,
        under[:, 0] / np.maximum(under[:, 6], 1), np.log1p(own[:, 0]), count, place, under[parent, 1] / np.maximum(under[parent, 0], 1), np.log1p(under[parent, 0]),
    ])


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept nodes: greatest sum of log-odds over sets that hold every kept node's parent."""
    best = odds.copy()
    best[0] = max(best[0], 0.0)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent.order] += best[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = best[i] > 0 and keep[nodes[i].parent.order]
    return keep


def blocks(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """Texts of kept nodes in page order."""
    out: list[str] = []
    stack: list[tuple[Node, int, list]] = [(nodes[0], 0, runs(nodes[0]))]
    while stack:
        node, child, texts = stack.pop()
        while texts and texts[0][0] <= child:
            out.append(texts.pop(0)[1])
        if child < len(node.children):
            stack.append((node, child + 1, texts))
            below = node.children[child]
            if keep[below.order]:
                stack.append((below, 0, runs(below)))
    return out


@lru_cache(maxsize=1)
def forest() -> trees.Forest:
    """Trained on made-up pages. An element is positive if it is, or holds, main text."""
    made = Pages(SEED)
    xs, ys, ws = [], [], []
    for _ in range(TRAINING_PAGES):
        nodes = nodes_of(parse(made.page()))
        bad = np.zeros(len(nodes), bool)
        for i, x in enumerate(nodes):
            bad[i] = x.attributes.get("data-kind") == "0" or (x.parent is not None and bad[x.parent.order])
        good = np.zeros(len(nodes), bool)
        for i in range(len(nodes) - 1, -1, -1):
            good[i] |= not bad[i] and bool(runs(nodes[i]))
            if good[i] and nodes[i].parent is not None:
                good[nodes[i].parent.order] = True
        xs.append(features(nodes))
        ys.append(good)
        ws.append(np.full(len(nodes), 1.0))
    return trees.fit(np.concatenate(xs), np.concatenate(ys), trees=50, depth=5, rate=0.3, bins=32, weight=np.concatenate(ws))


def extract(html: list[str | None], model: trees.Forest) -> list[str]:
    trees_of = [nodes_of(parse(h)) for h in html]
    if not trees_of:
        return []
    odds = model.margin(np.concatenate([features(nodes) for nodes in trees_of]))
    ends = np.cumsum([len(nodes) for nodes in trees_of])
    return ["\n".join(blocks(nodes, decode(nodes, odds[e - len(nodes) : e]))) for nodes, e in zip(trees_of, ends)]


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null or empty html gives an empty text, as does a page without main text. Broken
    markup is read as far as it goes; long pages are read whole. Rows are handled
    alone, so repeated rows give equal rows and an empty table gives none. Only
    page_id, url and html are read.
    """
    model = forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = extract(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    """extract_pages() of all pages; nulls, repeats and empty tables as there."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
