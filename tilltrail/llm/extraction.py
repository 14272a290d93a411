"""The main text of web pages: boosted trees judge the nodes of a page's tree, a decoding makes their choices agree.

Each node gets the log-odds that its subtree holds main text, from its tag, the words of its attributes, the density of text, links
and markup in its subtree, its depth and its place among its siblings. The choice of nodes is the most likely one in which no node
is kept below a dropped one: a node is worth its log-odds and what its children are worth where that is positive.

The trees are trained on pages laid out by ``layouts`` with words of a bounded sample of the corpus, whose main text is known, and
on the sample's own pages where they say in words which element is the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail.llm import boosting, layouts
from tilltrail.llm.dom import HEADINGS, Page, read_page, text_of

TRAINING_PAGES = 150
TRAINING_CHARS = 60_000
LAYOUTS = 1300
BATCH_NODES = 1 << 14

# Beginnings of attribute words that say what an element is for.
SAID = {
    "content": "article content post entry story main body text prose markdown",
    "menu": "nav menu breadcrumb pagination pager toc tabs toolbar skip sitemap topics categories tagcloud",
    "advert": "ad ads adv advert advertisement sponsor promo banner dfp adsense outbrain taboola affiliate partner commercial",
    "comment": "comment reply replies disqus respond response discussion thread feedback reader review guestbook",
    "side": "sidebar aside side widget related recommend more trending popular rail teaser also latest secondary complementary",
    "notice": "cookie consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall privacy message toast info",
    "share": "share social follow facebook twitter whatsapp button btn action tool tools print login search form",
    "frame": "header footer masthead copyright legal imprint colophon topbar bottombar contentinfo logo brand site",
}
WHOLE_WORDS = frozenset("ad ads adv nav side main body text more also info pager btn site form tool tools".split())
GROUPS = list(SAID)
TAGS = {
    "article": 0, "main": 0, "section": 1, "div": 2, "p": 3, **dict.fromkeys(HEADINGS, 4), "ul": 5, "ol": 5, "dl": 5, "li": 6, "dt": 6, "dd": 6,
    "nav": 7, "menu": 7, "header": 8, "hgroup": 8, "footer": 9, "address": 9, "aside": 10, "form": 11, "fieldset": 11, "label": 11, "legend": 11,
    "table": 12, "tr": 12, "td": 12, "th": 12, "tbody": 12, "thead": 12, "tfoot": 12, "caption": 12, "figure": 13, "figcaption": 13,
    "blockquote": 14, "pre": 14, "#text": 15, "#page": 16, "html": 16, "body": 16, "span": 17, "a": 17,
}
N_TAGS = 19
OUTSIDE = {7, 9, 10, 11}


def said_by(words: tuple[str, ...]) -> int:
    """Bits of the groups of ``SAID`` that the attribute words begin like."""
    bits = 0
    for word in words:
        for i, group in enumerate(GROUPS):
            if any(word == start or (start not in WHOLE_WORDS and word.startswith(start)) for start in SAID[group].split()):
                bits |= 1 << i
    return bits


_seen: dict[tuple[str, ...], int] = {}


def _said(words: tuple[str, ...]) -> int:
    if words not in _seen:
        if len(_seen) > 10_000:
            _seen.clear()
        _seen[words] = said_by(words)
    return _seen[words]


NOT_CONTENT = ~1
MARKS = re.compile("[.,;:!?]")


def marked(words: tuple[str, ...]) -> bool:
    """Whether a formatting element says that it is something else than content."""
    return bool(_said(words) & NOT_CONTENT)


def read(html_text: str) -> Page:
    return read_page(html_text, marked)


def features(pages: list[Page]) -> np.ndarray:
    """One row of numbers per node, page behind page; the pages' trees are worked on together, level by level."""
    nodes = [node for page in pages for node in page.nodes]
    n = len(nodes)
    sizes = np.array([len(page.nodes) for page in pages])
    first = np.cumsum(sizes) - sizes
    root = np.repeat(first, sizes)
    parent = np.fromiter((node.parent for node in nodes), np.int64, n) + root
    depth = np.fromiter((node.depth for node in nodes), np.int64, n)
    parent[first] = first
    own, begins = _own_text(pages, first, n)
    sums = np.zeros((n, 10))
    sums[:, :6] = own
    sums[:, 6] = [x for page in pages for x in page.links]
    sums[:, 7] = [x for page in pages for x in page.controls]
    sums[:, 8] = [node.tag == "p" for node in nodes]
    sums[:, 9] = 1
    tag = np.fromiter((TAGS.get(node.tag, 18) for node in nodes), np.int64, n)
    bits = np.fromiter((_said(node.words) if node.words else 0 for node in nodes), np.int64, n)
    hidden = np.fromiter((node.hidden for node in nodes), bool, n)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[1:]
    for at in reversed(levels):
        np.add.at(sums, parent[at], sums[at])
    above, outside, inside = np.zeros_like(bits), np.zeros(n), np.zeros(n)
    apart, article = np.isin(tag, list(OUTSIDE)), tag == 0
    for at in levels:
        p = parent[at]
        above[at] = above[p] | bits[p]
        outside[at] = np.maximum(outside[p], apart[p] | hidden[p])
        inside[at] = np.maximum(inside[p], article[p])
    flags, above_flags = ((b[:, None] >> np.arange(len(GROUPS))) & 1 for b in (bits, above))
    chars, links, words, marks = (sums[:, i] for i in range(4))
    some = np.maximum(chars, 1)
    index, count, mean, longest, before, after, same = _siblings(nodes, parent, depth, tag, chars)
    columns = [
        np.log1p(chars), links / some, words / np.maximum(sums[:, 5], 1), marks / np.maximum(words, 1), sums[:, 4] / np.maximum(sums[:, 5], 1),
        chars / some[root], chars / some[parent], np.log1p(own[:, 0]), sums[:, 9] / some * 100, np.log1p(sums[:, 6]),
        np.log1p(sums[:, 7]), np.log1p(sums[:, 8]), depth, index, np.log1p(count), np.log1p(mean), np.log1p(longest), np.log1p(before),
        np.log1p(after), same, begins, hidden, outside, inside, article[parent], chars / np.maximum(longest, 1), words, apart[parent],
    ]
    return np.column_stack([*columns, np.eye(N_TAGS)[tag], flags, flags[parent], above_flags]).astype(np.float64)


def _own_text(pages: list[Page], first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node of its own text: characters, those in links, words, marks, pieces that end a sentence, pieces; and where it begins."""
    own, begins = np.zeros((n, 6)), np.zeros(n)
    for page, base in zip(pages, first):
        at, starts = 0, []
        for node, _, text, linked in page.pieces:
            starts.append(at)
            at += len(text)
            if text and not text.isspace():
                row = own[base + node]
                row += (len(text), len(text) if linked else 0, text.count(" ") + 1, len(MARKS.findall(text)), text[-3:].rstrip()[-1:] in ".!?", 1)
        starts.append(at)
        for i, node in enumerate(page.nodes):
            begins[base + i] = starts[min(node.start, len(page.pieces))] / max(at, 1)
    return own, begins


def _siblings(nodes, parent: np.ndarray, depth: np.ndarray, tag: np.ndarray, chars: np.ndarray) -> list[np.ndarray]:
    """Among the children of one parent: place, number, mean and largest text, the texts next to it, share of its own tag."""
    n = len(nodes)
    out = [np.zeros(n) for _ in range(7)]
    kids = np.flatnonzero(depth > 0)
    if not len(kids):
        return out
    start = np.fromiter((nodes[i].start for i in kids), np.int64, len(kids))
    kids = kids[np.lexsort((kids, start, parent[kids]))]
    opens = np.flatnonzero(np.diff(parent[kids], prepend=-1))
    group = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(kids)))
    count = np.bincount(group)
    nth, sizes = np.arange(len(kids)) - opens[group], chars[kids]
    last = np.diff(group, append=len(opens)) > 0
    alike = np.unique(group * N_TAGS + tag[kids], return_inverse=True, return_counts=True)
    index, number, mean, longest, before, after, same = out
    index[kids] = nth / np.maximum(count[group] - 1, 1)
    number[kids] = count[group]
    mean[kids] = (np.add.reduceat(sizes, opens) / count)[group]
    longest[kids] = np.maximum.reduceat(sizes, opens)[group]
    before[kids] = np.where(nth > 0, np.roll(sizes, 1), 0)
    after[kids] = np.where(last, 0, np.roll(sizes, -1))
    same[kids] = alike[2][alike[1]] / count[group]
    return out


def decode(page: Page, worth: np.ndarray) -> list[bool]:
    """The most likely choice in which every kept node's parent is kept; ``worth`` are log-odds."""
    order = sorted(range(len(page.nodes)), key=lambda i: page.nodes[i].depth)
    best = worth.astype(float).tolist()
    for i in reversed(order):
        if page.nodes[i].parent >= 0 and best[i] > 0:
            best[page.nodes[i].parent] += best[i]
    kept = [False] * len(order)
    for i in order:
        above = page.nodes[i].parent
        kept[i] = best[i] > 0 and (above < 0 or kept[above])
    return kept


def extract(texts: list[str], model: boosting.BoostedTrees) -> list[str]:
    """The main text of each page; the trees judge the nodes of many pages at once."""
    found: list[str] = []
    held: list[Page] = []
    size = 0

    def flush() -> None:
        worth = model.log_odds(features(held))
        at = 0
        for page in held:
            kept = decode(page, worth[at : at + len(page.nodes)])
            found.append(text_of(page, kept))
            at += len(page.nodes)
        held.clear()

    for text in texts:
        held.append(read(text))
        size += len(held[-1].nodes)
        if size >= BATCH_NODES:
            flush()
            size = 0
    if held:
        flush()
    return found


# --- training -------------------------------------------------------------------------------------


def labels_of(page: Page) -> np.ndarray | None:
    """1 for nodes whose subtree holds main text: as marked by a layout, or as the page itself says; None where it does not say."""
    nodes = page.nodes
    if any(node.main is not None for node in nodes):
        own = [node.main == "1" for node in nodes]
    else:
        if not any(TAGS.get(node.tag) == 0 for node in nodes):
            return None
        inside, cut = [False] * len(nodes), [False] * len(nodes)
        for i in sorted(range(1, len(nodes)), key=lambda i: nodes[i].depth):
            p, node = nodes[i].parent, nodes[i]
            inside[i] = inside[p] or TAGS.get(node.tag) == 0
            cut[i] = cut[p] or node.hidden or TAGS.get(node.tag) in OUTSIDE or bool(_said(node.words) & NOT_CONTENT)
        own = [a and not b for a, b in zip(inside, cut)]
    holds = np.zeros(len(nodes))
    for node, _, text, _ in page.pieces:
        if own[node] and text.strip():
            holds[node] = 1
    for i in sorted(range(1, len(nodes)), key=lambda i: -nodes[i].depth):
        holds[nodes[i].parent] = max(holds[nodes[i].parent], holds[i])
    return holds


def train(sample: list[str], n_layouts: int = LAYOUTS) -> boosting.BoostedTrees:
    """The trees from a sample of pages. The same sample gives the same trees; an empty one leaves the layouts' own words."""
    pages = [read(text) for text in sample]
    texts = [" ".join(t.split()) for page in pages for _, _, t, linked in page.pieces if not linked and len(t) > 40]
    pages += [read(text) for text in layouts.pages(texts, n_layouts)]
    rows, labels, weights = [], [], []
    for page in pages:
        answer = labels_of(page)
        if answer is None or not answer.any():
            continue
        x = features([page])
        rows.append(x)
        labels.append(answer)
        weights.append(np.full(len(answer), min(1.0, 40 / len(answer))))
    return boosting.fit(np.concatenate(rows), np.concatenate(labels), np.concatenate(weights))


def training_sample(pages: DataFrame, size: int = TRAINING_PAGES) -> list[str]:
    """At most ``size`` different pages of at most ``TRAINING_CHARS``, those whose hash is least."""
    usable = pages.select("html", F.xxhash64("html").alias("hash")).filter(F.length("html").between(200, TRAINING_CHARS))
    # Only hashes are ranked: every task offers as many rows as are wanted in the end.
    least = [row.hash for row in usable.select("hash").distinct().orderBy("hash").limit(size).collect()]
    chosen = usable.filter(F.col("hash").isin(least)).groupBy("hash").agg(F.first("html").alias("html"))
    return [row.html for row in sorted(chosen.collect())]


# --- the operator ---------------------------------------------------------------------------------


def extract_pages(pages: DataFrame, model: boosting.BoostedTrees | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each page.

    Main text is what the trees and the decoding keep, in page order, each block's white space made single spaces, blocks joined by
    line ends, character references decoded. Scripts, styles, form controls and other unseen elements are never text.

    A null or empty html gives an empty text; so does a page without any text. Repeated pages are answered each. Whole pages are
    read. An empty table gives no rows. Only ``page_id``, ``url`` and ``html`` are read, so other names cannot clash. The model is
    trained on at most ``TRAINING_PAGES`` pages (150, at most 60,000 characters each) unless one is given.
    """
    trees = model or train(training_sample(pages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = extract([h or "" for h in batch["html"]], trees)
            out = batch[["page_id", "url"]].copy()
            out["text"], out["n_chars"] = texts, [len(t) for t in texts]
            yield out

    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {types['page_id']}, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInPandas(run, schema)
