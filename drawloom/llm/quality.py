"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are plain counts and ratios of the whole text.  The trees are grown
level by level from per-node histograms of gradients over quantile bins, then
flattened into arrays that numpy walks for all documents and trees at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of
from .labelled import sample

FEATURES = (
    "chars", "words", "lines", "word_length", "longest_word", "upper", "digits", "spaces", "newlines", "punctuation", "symbols", "non_ascii", "control", "distinct_words", "top_word", "top5_words",
    "short_words", "upper_words", "wordless", "tailed_words", "line_length", "repeated_lines", "repeated_bigrams", "line_ends", "packed",
)


def _byte_classes() -> np.ndarray:
    """0 letters, 1 capitals, 2 digits, 3 blanks, 4 newlines, 5 punctuation of prose, 6 other symbols, 7 non-ASCII, 8 control characters."""
    kinds = np.full(256, 6)
    kinds[:32] = 8
    kinds[127] = 8
    kinds[[9, 32]] = 3
    kinds[[10, 13]] = 4
    kinds[[ord(c) for c in ".,;:'\"?!()-"]] = 5
    kinds[48:58], kinds[65:91], kinds[97:123], kinds[128:] = 2, 1, 0, 7
    return kinds


BYTE_CLASS = _byte_classes()


def statistics(text: str) -> list[float]:
    """The values of FEATURES for one text; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    by = np.bincount(BYTE_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9) / len(raw)
    found, rows = text.split(), [x for x in text.split("\n") if x]
    n, counts = max(len(found), 1), Counter(found)
    top = [c for _, c in counts.most_common(5)] or [0]
    pairs = len(set(zip(found, found[1:])))
    return [
        np.log1p(len(text)), np.log1p(len(found)), np.log1p(len(rows)), sum(map(len, found)) / n, float(max(map(len, found), default=0)), by[1], by[2], by[3], by[4], by[5], by[6], by[7], by[8], len(counts) / n, top[0] / n, sum(top) / n,
        sum(len(w) <= 3 for w in found) / n, sum(map(str.isupper, found)) / n, sum(not any(map(str.isalnum, w)) for w in counts) / max(len(counts), 1), sum(len(w) > 1 and not (w[-1].isalnum() or w[-2].isalnum()) for w in found) / n,
        np.log1p(len(text) / max(len(rows), 1)), 1 - len(set(rows)) / max(len(rows), 1), 1 - pairs / max(len(found) - 1, 1), sum(x[-1] in ".!?:;" for x in rows) / max(len(rows), 1), len(zlib.compress(raw, 1)) / len(raw),
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Flat arrays of all trees: a node goes left if its feature's value is at most its cut; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of x."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.bias)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boost ``trees`` trees of the logistic loss; with no rows, or one class, the smoothed share of label 1 alone."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            raw += _grow(binned, edges, y - p, p * (1 - p), nodes, roots, depth, bins, rate, ridge, least)
    flat = np.array(nodes, float).reshape(len(nodes), 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), depth, bias)


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, nodes: list, roots: list, depth: int, bins: int, rate: float, ridge: float, least: int) -> np.ndarray:
    """Append one tree and return what it adds to each row's raw score."""
    root = len(nodes)
    roots.append(root)
    nodes.append([0, np.inf, root, root, 0.0])
    where = np.full(len(g), root)
    level = [root]
    for _ in range(depth):
        slot = {node: i for i, node in enumerate(level)}
        of = np.array([slot.get(i, -1) for i in range(len(nodes))])[where]
        live = of >= 0
        best = [(1e-6, -1, 0)] * len(level)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            cell = of[live] * bins + binned[live, j]
            size = len(level) * bins
            sums = [np.bincount(cell, w, size).reshape(-1, bins).cumsum(1) for w in (g[live], h[live], np.ones(live.sum()))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            gain[:, len(e) :] = -1
            for k, b in enumerate(gain.argmax(1)):
                if gain[k, b] > best[k][0]:
                    best[k] = (gain[k, b], j, int(b))
        after = []
        for node, (_, j, b) in zip(level, best):
            if j < 0:
                continue
            pair = len(nodes)
            nodes += [[0, np.inf, pair, pair, 0.0], [0, np.inf, pair + 1, pair + 1, 0.0]]
            nodes[node][:4] = [j, edges[j][b], pair, pair + 1]
            own = where == node
            where[own] = np.where(binned[own, j] <= b, pair, pair + 1)
            after += [pair, pair + 1]
        level = after
    for node in np.unique(where):
        own = where == node
        nodes[node][4] = rate * g[own].sum() / (h[own].sum() + ridge)
    return np.array([x[4] for x in nodes[root:]])[where - root]


class Scorer:
    """Replaces the text by its score."""

    def __init__(self, model: Trees) -> None:
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = self.model.score(matrix(texts_of(batch, "_text")))
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_text"]
            yield pa.record_batch([c for _, c in kept] + [pa.array(scores, pa.float64())], names=[n for n, _ in kept] + ["score"])


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(texts_of(batch, "_text"))
        yield pa.record_batch([batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_y")), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_y", "x"])


def train(docs: DataFrame, labels: DataFrame, *, held: Column, label: str = "quality", max_rows: int = 20_000, **shape: float) -> Trees:
    """Fit on at most ``max_rows`` labelled documents that are not held out.

    Null texts count as empty, null labels are left out, a document with several
    labels has their majority, and a table without labels gives a constant score.
    """
    rows = sample(docs, labels, label, held, max_rows)
    kind = rows.schema["_id"].dataType.simpleString()
    got = arrow_map(rows.select("_id", "_y", "_text"), _statistics_batches, f"_id {kind}, _y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y = got["_y"].to_numpy(float)
    order = np.lexsort((*x.T, y, got["_id"].to_numpy()))
    return fit(x[order], y[order], **shape)


def score(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document, whole texts; null and empty texts are scored too, repeated rows each; no shuffle."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return arrow_map(rows, Scorer(model), f"_id {kind}, score double").withColumnRenamed("_id", id_col)
