"""Whitening of vectors by hierarchical merging of singular value decompositions.

Every task decomposes the vectors it holds, centred on their own mean, and keeps all
singular values and right vectors beside the count and the exact sums.  Two such
summaries merge without a loss: their values times their vectors are stacked, a row of
the weighted difference of the means is appended, and the stack is decomposed again.
Groups of summaries merge in tasks, level by level, until one a vector length is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: Numbers of vectors that are decomposed at once.
CHUNK = 1 << 20
#: Bytes of the summaries that one task merges, about; two at least.
MERGED_BYTES = 128 << 20
SUMMARY = "_dims int, _node long, _n long, _sums array<decimal(38,0)>, _values binary, _vectors binary"


@dataclass
class Summary:
    """Count, exact sums, and all singular values and right vectors (as rows) of centred vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of whole numbers, a row a vector."""
        sums = exact_sums(x)
        return cls(len(x), sums, *decomposed(x - means(sums, len(x))))

    def merged(self, other: Summary) -> Summary:
        """Of the rows of both, none of the dimensions given up."""
        n = self.n + other.n
        between = math.sqrt(self.n / n * other.n) * (means(self.sums, self.n) - means(other.sums, other.n))
        parts = self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, between[None]
        return Summary(n, self.sums + other.sums, *decomposed(np.concatenate(parts)))


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers, which don't overflow."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


def means(sums: np.ndarray, n: int) -> np.ndarray:
    return np.array([s / n for s in sums.tolist()], np.float64)


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values, the largest first, and right vectors; dimensions that the rows don't span have the value 0."""
    dims = rows.shape[1]
    if len(rows) < dims:
        rows = np.concatenate([rows, np.zeros((dims - len(rows), dims))])
    return np.linalg.svd(rows, full_matrices=False)[1:]


def row_of(dims: int, node: int, s: Summary) -> dict:
    sums = [Decimal(x) for x in s.sums.tolist()]
    vectors = np.ascontiguousarray(s.vectors).tobytes()
    return {"_dims": dims, "_node": node, "_n": s.n, "_sums": sums, "_values": s.values.tobytes(), "_vectors": vectors}


def summary_of(row) -> Summary:
    values = np.frombuffer(row["_values"])
    return Summary(int(row["_n"]), np.array([int(x) for x in row["_sums"]], object), values, np.frombuffer(row["_vectors"]).reshape(len(values), -1))


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary a task and vector length; vectors come in column 0."""
    held: dict[int, Summary] = {}
    for batch in batches:
        for x in by_length(batch.column(0)).values():
            step = max(1, CHUNK // x.shape[1])
            for at in range(0, len(x), step):
                own = Summary.of(x[at : at + step])
                held[x.shape[1]] = held[x.shape[1]].merged(own) if x.shape[1] in held else own
    if held:
        node = TaskContext.get().partitionId()
        schema = pa.schema([("_dims", pa.int32()), ("_node", pa.int64()), ("_n", pa.int64()), ("_sums", pa.list_(pa.decimal128(38, 0))), ("_values", pa.binary()), ("_vectors", pa.binary())])
        yield pa.RecordBatch.from_pylist([row_of(d, node, s) for d, s in held.items()], schema)


def by_length(column: pa.Array) -> dict[int, np.ndarray]:
    """The vectors of a list column by their length; those without entries are left out."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths[lengths > 0]).tolist():
        out[d] = flat[(starts[lengths == d][:, None] + np.arange(d)).ravel()].reshape(-1, d)
    return out


def merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.sort_values("_node").to_dict("records")
    total = summary_of(rows[0])
    for row in rows[1:]:
        total = total.merged(summary_of(row))
    return pd.DataFrame([row_of(int(rows[0]["_dims"]), int(rows[0]["_node"]), total)])


def merged(summaries: DataFrame) -> DataFrame:
    """One summary a vector length, by levels of groups in tasks, each level written to the shared folder."""
    now = materialize(summaries, "whitening-0")
    # Two numbers: the largest task's and the greatest length.
    most, dims = now.agg(F.coalesce(F.max("_node"), F.lit(0)), F.coalesce(F.max("_dims"), F.lit(1))).first()
    fan = max(2, min(64, MERGED_BYTES // (8 * dims * dims)))
    level = 0
    while most > 0:
        level, most = level + 1, most // fan
        grouped = now.withColumn("_node", F.expr(f"_node div {fan}")).groupBy("_dims", "_node")
        now = materialize(grouped.applyInPandas(merge_group, SUMMARY), f"whitening-{level}")
    return now


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _x array<long>): floor(scale * entry); without null vectors and those with null, non-finite or overflowing entries."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= F.lit(float(1 << 62))))
    return rows.filter(F.col("_v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("_id", F.transform("_v", lambda c: F.floor(c * scale).cast("long")).alias("_x"))


@dataclass
class Model:
    """Of one vector length: count, exact sums, components as rows with their eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @classmethod
    def of(cls, s: Summary, k: int) -> Model:
        eigenvalues = s.values**2 / s.n
        top = s.vectors[:k]
        # The entry of largest size is positive, so the sign doesn't depend on the merges.
        top = top * np.where(np.take_along_axis(top, np.abs(top).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
        return cls(s.n, s.sums, top, eigenvalues[:k], float(eigenvalues.sum()))

    def spans(self) -> np.ndarray:
        """Components along which the vectors differ beyond rounding."""
        return self.eigenvalues > self.trace * (len(self.sums) * np.finfo(float).eps) ** 2

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        sums = [int(v) for v in self.sums]
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
            return self.n * x - np.array(sums, np.int64)
        return self.n * x.astype(object) - np.array(sums, object)

    def deviations(self, d: np.ndarray) -> list[int]:
        """Sums of the squares of the rows of differences, exact; beyond a long they are an error."""
        if d.dtype != object and len(self.sums) * float(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
            return (d * d).sum(axis=1).tolist()
        out = [sum(v * v for v in map(int, row)) for row in d.tolist()]
        if max(out, default=0) >= 1 << 63:
            raise OverflowError("deviation doesn't fit into a long")
        return out

    def whitened(self, d: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (d.astype(np.float64) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


class Whiten:
    """Adds _dims, _deviation and _white (null entries for components without variance) to rows whose last column is the vector."""

    def __init__(self, models: dict[int, Model]) -> None:
        self.models = models

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            lengths = np.diff(vectors.offsets.to_numpy())
            for dims, x in by_length(vectors).items():
                model = self.models[dims]
                d = model.differences(x)
                white, spans = model.whitened(d), model.spans()
                rows = [[v if ok else None for v, ok in zip(row, spans)] for row in white.tolist()]
                kept = [c.filter(pa.array(lengths == dims)) for c in batch.columns[:-1]]
                added = pa.array(np.full(len(x), dims, np.int32)), pa.array(model.deviations(d), pa.int64()), pa.array(rows, pa.list_(pa.float64()))
                yield pa.record_batch([*kept, *added], names=[*batch.schema.names[:-1], "_dims", "_deviation", "_white"])


def whiten(vectors: DataFrame, *, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each usable vector and component: the id, component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers, floor(``scale`` * entry); the fit takes each different
    vector once.  component counts from 1 by falling eigenvalue; n is the size of the fit
    list; deviation the exact sum over the dimensions of (n * x - sum)^2, an error beyond
    a long; whitened the centred vector along the component over the root of its
    eigenvalue; explained the eigenvalue's share of the trace; identity_error the largest
    absolute entry of the covariance of whitened, over the fit list, minus the identity.

    Null vectors and those with null or non-finite entries, or entries that leave a long,
    are left out, as are empty ones, which have no component.  Vectors of different
    lengths are fitted apart; one of fewer entries than ``components`` has fewer rows.
    Components without variance (one vector, equal ones) have a null whitened, take no
    part in identity_error (null if none is left) and explain 0.  Rows that repeat are
    rows of their own and count once in the fit; equal eigenvalues have their components
    in any order; null ids are kept; an empty table gives no rows.
    """
    rows = materialize(quantised(vectors, scale, id_col, vector_col), "whitening-rows")
    fit = materialize(rows.select("_x").distinct(), "whitening-fit")
    # One summary a vector length, of a size that only the length decides.
    models = {r["_dims"]: Model.of(summary_of(r), components) for r in merged(arrow_map(fit, summarise, SUMMARY)).collect()}
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    entry = lambda i: F.get("_white", F.lit(i))
    seen = arrow_map(fit.select("_x"), Whiten(models), "_dims int, _deviation long, _white array<double>")
    off = F.array(*(F.abs(F.covar_pop(entry(i), entry(j)) - F.lit(float(i == j))) for i, j in pairs))
    errors = {r[0]: r[1] for r in seen.groupBy("_dims").agg(F.array_max(off)).collect()}
    known = [
        (d, i + 1, m.n, float(m.eigenvalues[i] / m.trace) if m.trace else 0.0, errors.get(d))
        for d, m in models.items() for i in range(len(m.components))
    ]
    table = vectors.sparkSession.createDataFrame(known, "_dims int, component int, n long, explained double, identity_error double")
    kind = rows.schema["_id"].dataType.simpleString()
    made = arrow_map(rows.select("_id", "_x"), Whiten(models), f"_id {kind}, _dims int, _deviation long, _white array<double>")
    each = made.select("_id", "_dims", "_deviation", F.posexplode("_white").alias("_at", "whitened")).withColumn("component", F.col("_at") + 1)
    return each.join(F.broadcast(table), ["_dims", "component"]).select(F.col("_id").alias(id_col), "component", "n", F.col("_deviation").alias("deviation"), "whitened", "explained", "identity_error")
