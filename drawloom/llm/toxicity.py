"""Counterfactual-regularised toxicity classifier.

A logistic model over the words and word beginnings of a text.  Each labelled text
that names a group also enters with its identity terms swapped, and the loss
penalises the square of the change of its score, so that a term that merely occurs
in toxic texts of the sample doesn't make a neutral mention toxic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, arrow_map, packed, texts_of, unpacked
from .labelled import sample

# Identity terms, in groups whose terms are swapped round.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees"), ("immigrant", "native", "refugee"), ("old", "young"), ("deaf", "blind", "disabled", "autistic"),
    ("femmes", "hommes"), ("musulmans", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {a.encode(): b.encode() for group in IDENTITY_GROUPS for a, b in zip(group, group[1:] + group[:1])}
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 6)


def words(text: str) -> set[bytes]:
    """The different words of the whole text, lower-cased."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split())


def features(found: set[bytes]) -> set[bytes]:
    """Marks of the words (=) and of the beginnings of longer ones (^)."""
    out = {b"=" + w for w in found}
    for n in BEGINNINGS:
        out |= {b"^" + w[:n] for w in found if len(w) > n}
    return out


@dataclass
class Model:
    names: list[bytes]
    weights: np.ndarray
    bias: float
    index: dict[bytes, float] = field(init=False)

    def __post_init__(self) -> None:
        self.index = dict(zip(self.names, self.weights.tolist()))
        self.whole = {n[1:] for n in self.names if n[:1] == b"="}
        self.begin = {k: {n[1:] for n in self.names if n[:1] == b"^" and len(n) == k + 1} for k in BEGINNINGS}

    def logit(self, text: str) -> float:
        found = words(text)
        hits = [b"=" + w for w in self.whole & found]
        for k, wanted in self.begin.items():
            hits += [b"^" + w for w in wanted & {w[:k] for w in found if len(w) > k}]
        return self.bias + sum(self.index[h] for h in sorted(hits))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip([self.logit(t) for t in texts], -40, 40)))


def fit(rows: list[np.ndarray], swapped: dict[int, np.ndarray], y: np.ndarray, size: int, *, counterfactual: float = 1.0, ridge: float = 1e-4, steps: int = 250, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias; rows: feature numbers of each text; swapped: the same of its counterfactual.

    Loss: mean logistic loss + counterfactual * mean (logit - swapped logit)^2 + ridge * |w|^2, by full-batch Adam.
    """
    share = (y.sum() + 0.5) / (len(y) + 10)
    bias, w = float(np.log(share / (1 - share))), np.zeros(size)
    if not size or not len(y) or y.sum() in (0, len(y)):
        return w, bias
    at = np.concatenate(rows).astype(int)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pairs = sorted(swapped)
    d_at = np.concatenate([np.concatenate([rows[i], swapped[i]]) for i in pairs]).astype(int) if pairs else np.zeros(0, int)
    d_row = np.concatenate([np.full(len(rows[i]) + len(swapped[i]), k) for k, i in enumerate(pairs)]) if pairs else np.zeros(0, int)
    d_sign = np.concatenate([np.repeat([1.0, -1.0], [len(rows[i]), len(swapped[i])]) for i in pairs]) if pairs else np.zeros(0)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[at], len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(at, r[row], size) + 2 * ridge * w, r.sum())
        if pairs:
            change = np.bincount(d_row, d_sign * w[d_at], len(pairs))
            grad[:size] += 2 * counterfactual / len(pairs) * np.bincount(d_at, d_sign * change[d_row], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:size], bias - float(step[size])
    return w, bias


class _Counts:
    """Counts, in each task, the texts of one label that have a feature; wanted: None for all."""

    def __init__(self, wanted: set[bytes] | None) -> None:
        self.wanted = wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch, "_text"):
                own = features(words(text))
                counts.update(own if self.wanted is None else own & self.wanted)
        yield pa.record_batch([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["f", "n"])


class _Rows:
    """Feature numbers of each text, and of its counterfactual if it names a group."""

    def __init__(self, names: list[bytes]) -> None:
        self.index = {n: i for i, n in enumerate(names)}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, swap = [], []
            for text in texts_of(batch, "_text"):
                found = words(text)
                own.append(sorted(self.index[f] for f in features(found) & self.index.keys()))
                other = {SWAP.get(w, w) for w in found}
                swap.append(sorted(self.index[f] for f in features(other) & self.index.keys()) if other != found else None)
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_y")), pa.array(own, kind), pa.array(swap, kind)], names=["_id", "_y", "own", "swap"])


def train(docs: DataFrame, labels: DataFrame, *, held: Column, label: str = "toxic", max_rows: int = 20_000, max_features: int | None = None, least: int = 3, counterfactual: float = 1.0) -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out.

    Features are all marks of ``least`` toxic texts or more whose z score of the smoothed
    log odds is over 2 (the ``max_features`` highest, if given), and the identity terms
    of the sample.  Null
    texts count as empty, null labels are left out, a document with several labels has
    their majority, and a table without labels gives the constant score 0.05.
    """
    rows = sample(docs, labels, label, held, max_rows).select("_id", "_y", "_text")
    sizes = dict(rows.groupBy("_y").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    names: list[bytes] = []
    if toxic and clean:
        count = lambda df, wanted: arrow_map(df, _Counts(wanted), "f binary, n long").groupBy("f").agg(F.sum("n").alias("n"))
        seen = count(rows.filter("_y = 1"), None).filter(F.col("n") >= least).collect()
        in_toxic = {bytes(r.f): r.n for r in seen}
        terms = {b"=" + t for t in SWAP}
        in_clean = {bytes(r.f): r.n for r in count(rows.filter("_y = 0"), set(in_toxic) | terms).collect()}

        def surely(f: bytes) -> float:
            a, b = in_toxic[f] + 0.5, in_clean.get(f, 0) + 0.5
            c, d = toxic - a + 1, clean - b + 1
            return (np.log(a / c) - np.log(b / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)

        ranked = sorted(((surely(f), f) for f in in_toxic), key=lambda x: (-x[0], x[1]))
        names = sorted({f for z, f in ranked[:max_features] if z > 2} | {t for t in terms if t in in_toxic or t in in_clean})
    kind = rows.schema["_id"].dataType.simpleString()
    got = sorted(arrow_map(rows, _Rows(names), f"_id {kind}, _y int, own array<int>, swap array<int>").collect(), key=lambda r: (str(r._id), r.own))
    own = [np.array(r.own, int) for r in got]
    swapped = {i: np.array(r.swap, int) for i, r in enumerate(got) if r.swap is not None}
    w, bias = fit(own, swapped, np.array([r._y for r in got], float), len(names), counterfactual=counterfactual)
    return Model(names, w, bias)


class Scorer:
    """Adds the score of each text as ``column``."""

    def __init__(self, model: Model, text_col: str, column: str, drop_text: bool) -> None:
        self.model, self.text_col, self.column, self.drop_text = model, text_col, column, drop_text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(self.model.score(texts_of(batch, self.text_col)), pa.float64())
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != self.column and not (self.drop_text and n == self.text_col)]
            yield pa.record_batch([c for _, c in kept] + [scores], names=[n for n, _ in kept] + [self.column])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document, whole texts; null and empty texts have the score of the bias, repeated rows each; no shuffle."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return arrow_map(rows, Scorer(model, "_text", "score", True), f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def remove_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; same columns, no shuffle.

    Whole texts are scored; null and empty ones have the score of the bias; rows that
    repeat go or stay alike; an empty table gives no rows; no column can clash.
    """
    rows = packed(docs, _text=F.col("text").cast("string"))
    scored = arrow_map(rows, Scorer(model, "_text", "_score", True), T.StructType([rows.schema["_row"], T.StructField("_score", T.DoubleType())]))
    return unpacked(scored.filter(F.col("_score") < threshold))
