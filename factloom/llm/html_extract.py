"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each block element and each run of text is a node with features of its own
(tag, attribute tokens, depth), of its subtree (text, link and tag density), of
its ancestors and of its siblings.  Boosted trees, trained here in numpy on
generated pages with known main text, give each node the probability that it
holds main text.  Decoding is hierarchical: of all choices in which a dropped
node has no kept descendant, the one of highest total likelihood is taken, in
two passes over the tree.

Defined cases: a null or empty page has empty text; pages cut off anywhere are
read to their end; the content of ``noscript`` counts where a page has no other
main text; nesting of any depth takes linear time; repeated rows and further columns are passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release
from .html_pages import training_pages
from .html_tree import SILENT, Node, parse
from .textkernel import slices

#: Bytes of pages parsed together; a longer page is taken alone.
PAGE_BYTES = 4_000_000
NOSCRIPT = re.compile("<noscript", re.I)
# Words in class, id and role attributes, by what they usually mark.
MAIN_TOKENS = frozenset("article articlebody body content entry main maincontent post posting prose read reading richtext story text".split())
SIDE_TOKENS = frozenset("aside breadcrumb breadcrumbs footer header masthead menu menubar nav navbar navigation pagination rail related sidebar sidenav social share sharing tags toc topbar toolbar widget bottom byline meta".split())
NOTICE_TOKENS = frozenset("ad ads adslot advert advertisement alert banner consent cookie cookies gdpr modal newsletter notice notification overlay paywall popup promo promoted sponsor sponsored subscribe signup".split())
TALK_TOKENS = frozenset("comment comments commentlist discussion disqus form login reply replies respond responses reviews search searchform thread".split())
TAG_GROUPS = {
    "main": 1, "article": 1, "section": 2, "div": 3, "p": 4, "h1": 5, "h2": 5, "h3": 5, "h4": 5, "h5": 5, "h6": 5,
    "ul": 6, "ol": 6, "dl": 6, "menu": 6, "li": 7, "dt": 7, "dd": 7, "table": 8, "tbody": 8, "tr": 8, "td": 8, "th": 8,
    "blockquote": 9, "pre": 9, "figure": 9, "figcaption": 9, "nav": 10, "footer": 11, "header": 12, "aside": 13,
    "form": 14, "fieldset": 14, "button": 14, "input": 14, "dialog": 15, "address": 15, "#": 16, "body": 17, "html": 17, "#root": 17,
}
SIDE_TAGS = frozenset("nav footer aside form header button dialog fieldset".split())
N_FEATURES = 28


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features per node of one page."""
    return features_of([nodes])


def features_of(trees: list[list[Node]]) -> np.ndarray:
    """One row of features per node of several pages, a tree level at a time."""
    nodes = [x for t in trees for x in t]
    n = len(nodes)
    sizes = np.array([len(t) for t in trees])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    depth = np.array([x.depth for x in nodes])
    up = np.array([x.parent for x in nodes]) + base
    roots = depth == 0
    up[roots] = np.flatnonzero(roots)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []

    text = [len(x.text) for x in nodes]
    # characters, link characters, tags, runs, long runs, stops; summed over subtrees
    total = np.array([text, [x.link_chars for x in nodes], [x.tags for x in nodes], [x.tag == "#" for x in nodes], [c > 80 for c in text], [x.text.count(".") + x.text.count(",") for x in nodes]], dtype=float).T.copy()
    before = np.cumsum(total[:, 0]) - total[:, 0]
    for level in levels[:0:-1]:
        np.add.at(total, up[level], total[level])
    chars, links, tags, leaves, long_leaves, stops = total.T
    page = np.maximum(1.0, chars[base])

    own = np.zeros((n, 4))
    for k, x in enumerate(nodes):
        if x.tokens:
            own[k] = [sum(w in words for w in x.tokens) for words in (MAIN_TOKENS, SIDE_TOKENS, NOTICE_TOKENS, TALK_TOKENS)]
    side = np.array([x.tag in SIDE_TAGS for x in nodes], dtype=float)
    main = np.array([x.tag in ("article", "main") for x in nodes], dtype=float)
    mine = np.column_stack([own, side, main])
    above = np.zeros((n, 6))  # tokens, side tags and main tags of ancestors
    for level in levels[1:]:
        above[level] = above[up[level]] + mine[up[level]]

    group = np.array([TAG_GROUPS.get(x.tag, 0) for x in nodes])
    children = np.array([len(x.children) for x in nodes])
    brothers = np.where(roots, 1, children[up])
    out = np.zeros((n, N_FEATURES))
    out[:, :8] = np.column_stack([group, group[up], depth, brothers, children, side, main, [x.hidden for x in nodes]])
    out[:, 8] = chars[up] / page
    out[:, 9] = links[up] / np.maximum(1.0, chars[up])
    out[:, 10] = chars / np.maximum(1.0, chars[up])
    out[:, 11] = long_leaves[up] / np.maximum(1, brothers)
    out[:, 12] = np.log1p(chars)
    out[:, 13] = links / np.maximum(1, chars)
    out[:, 14] = chars / (1 + tags + leaves)
    out[:, 15] = leaves
    out[:, 16] = long_leaves
    out[:, 17] = stops / np.maximum(1, chars)
    out[:, 18] = chars / page
    out[:, 19] = (before - before[base]) / page
    out[:, 20:24] = own
    out[:, 24] = above[:, 0]
    out[:, 25] = above[:, 1:4].sum(axis=1)
    out[:, 26] = above[:, 4]
    out[:, 27] = above[:, 5]
    return out


@dataclass
class Forest:
    """Oblivious trees: each level of a tree tests one feature for all its nodes."""

    feature: np.ndarray  # trees x depth
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.value):
            leaf = np.zeros(len(x), dtype=np.int64)
            for k in range(len(f)):
                leaf = 2 * leaf + (x[:, f[k]] > t[k])
            out += v[leaf]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 4.0) -> Forest:
    """Logistic gradient boosting with Newton leaf values over quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    logit = np.full(len(y), base)
    features_, thresholds, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-logit))
        grad, hess = y - prob, prob * (1 - prob)
        leaf = np.zeros(len(y), dtype=np.int64)
        fs, ts = [], []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                width = len(e) + 1
                key = leaf * width + binned[:, j]
                g = np.bincount(key, weights=grad, minlength=width << level).reshape(-1, width)
                h = np.bincount(key, weights=hess, minlength=width << level).reshape(-1, width)
                gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                gr, hr = g.sum(axis=1, keepdims=True) - gl, h.sum(axis=1, keepdims=True) - hl
                gain = (gl**2 / (hl + ridge) + gr**2 / (hr + ridge)).sum(axis=0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), j, k)
            _, j, k = best
            fs.append(j)
            ts.append(float(edges[j][k]) if len(edges[j]) else 0.0)
            leaf = 2 * leaf + (x[:, j] > ts[-1])
        g = np.bincount(leaf, weights=grad, minlength=1 << depth)
        h = np.bincount(leaf, weights=hess, minlength=1 << depth)
        value = rate * g / (h + ridge)
        logit += value[leaf]
        features_.append(fs)
        thresholds.append(ts)
        values.append(value)
    return Forest(np.array(features_), np.array(thresholds), np.array(values), base)


def train(pages: int = 300) -> Forest:
    """Fit on generated pages; a node is positive if a marked run is below it."""
    xs, ys = [], []
    for source, main in training_pages(pages):
        nodes = parse(source)
        label = np.array([x.tag == "#" and any(w.startswith(main) for w in x.text.split()) for x in nodes], dtype=float)
        for k in range(len(nodes) - 1, 0, -1):
            label[nodes[k].parent] = max(label[nodes[k].parent], label[k])
        xs.append(features(nodes))
        ys.append(label)
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which no dropped node has a kept descendant."""
    logit = np.clip(logit, -12, 12)
    # plain lists: pages are small and the passes go node by node
    best_keep, subtree_drop = (-np.logaddexp(0, -logit)).tolist(), (-np.logaddexp(0, logit)).tolist()
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        subtree_drop[up] += subtree_drop[k]
        best_keep[up] += max(best_keep[k], subtree_drop[k])
    kept = [True] + [False] * (len(nodes) - 1)
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].parent] and best_keep[k] > subtree_drop[k]
    return np.array(kept)


def main_texts(sources: list[str | None], forest: Forest) -> list[str]:
    """Kept runs of each page, one per line; those of ``noscript`` elements where a page has no other."""
    out = _texts([parse(s) for s in sources], forest)
    bare = [k for k, s in enumerate(sources) if s and not out[k] and NOSCRIPT.search(s)]
    for k, text in zip(bare, _texts([parse(sources[k], noscript=True) for k in bare], forest)):
        out[k] = text
    return out


def _texts(trees: list[list[Node]], forest: Forest) -> list[str]:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in trees])])
    logit = forest.logits(features_of(trees)) if trees else np.zeros(0)
    out = []
    for k, nodes in enumerate(trees):
        kept = decode(nodes, logit[bounds[k] : bounds[k + 1]])
        out.append("\n".join(x.text for x, y in zip(nodes, kept) if y and x.tag == "#" and (nodes[x.parent].tag == "noscript" or nodes[x.parent].tag not in SILENT)))
    return out


def extract(pages: DataFrame, forest: Forest | None = None, rows: int = 64) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(vars(forest or train()))

    def run(batches):
        forest = Forest(**shared.value)
        for batch in batches:
            for part in (some.slice(at, rows) for some in slices(batch, "html", PAGE_BYTES) for at in range(0, some.num_rows, rows)):
                texts = main_texts(part.column("html").to_pylist(), forest)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        release()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
