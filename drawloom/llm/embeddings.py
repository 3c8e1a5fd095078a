"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal unit vectors of a label become one row first.  A label's vectors are rotated
by its principal axes and cut into tiles along the first one; only tiles whose boxes on
the leading axes are closer than the threshold allows are paired.  A pair of tiles is compared from the leading
dimensions on: the partial product plus the product of the suffix norms bounds the
cosine, and pairs whose bound is below the threshold are dropped before the next
dimensions are read.  Cosines are in double precision; the few within 1e-9 of the
threshold are taken again from the unrotated vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: Bytes of the coordinates of a tile, about; a label that fits is one tile.
TILE_BYTES = 4 << 20
#: Bytes of the vectors that are rotated by one task at once, about.
ROTATED_BYTES = 16 << 20
#: Leading axes of which a tile knows its least and largest coordinates.
BOX = 8
#: Pairs of vectors that are compared at once.
PAIRS = 1 << 22
#: Dimensions after which the bound is checked.
STEPS = (8, 16, 32)
#: Slack of the bounds and tile gaps for rounding; the last comparison has none.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, first divided by their largest component so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def axes(moments: np.ndarray) -> np.ndarray:
    """Columns: eigenvectors of the second moments, the largest first."""
    values, vectors = np.linalg.eigh(moments)
    return vectors[:, np.argsort(-values, kind="stable")]


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of x and j of y that may reach the threshold, by leading dimensions and suffix norms, and their cosines."""
    dims = x.shape[1]
    cuts = [c for c in steps if c < dims]
    done = cuts[0] if cuts else dims
    part = x[:, :done] @ y[:, :done].T
    rest = lambda v, k: np.sqrt(np.maximum((v[:, k:] ** 2).sum(1), 0))
    i, j = np.nonzero(part + np.outer(rest(x, done), rest(y, done)) >= threshold - SLACK)
    part = part[i, j]
    for after in [*cuts[1:], dims] if cuts else []:
        part = part + np.einsum("nd,nd->n", x[i, done:after], y[j, done:after])
        done = after
        keep = part + rest(x, done)[i] * rest(y, done)[j] >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, part


def all_close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``close_pairs``, some rows of x at a time so that memory stays bounded; same: x is y, and only pairs i < j count."""
    out = []
    step = max(1, PAIRS // max(len(y), 1))
    for at in range(0, len(x), step):
        from_row = at if same else 0
        i, j, cosine = close_pairs(x[at : at + step], y[from_row:], threshold)
        i, j = i + at, j + from_row
        keep = i < j if same else np.ones(len(i), bool)
        out.append((i[keep], j[keep], cosine[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else close_pairs(x, y, threshold)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of pairs that connect all that the pairs connect, without a circle."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[rx] = ry
            out.append(k)
    return out


def _tile_pairs(threshold: float):
    """What a pair of tiles adds: rows (a, null, n) with the vectors that class a links with, (a, b) of a spanning forest, and (a, b, near).

    near: pairs too close to the threshold for rotated coordinates, linked or not.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [pd.DataFrame({"a": pd.Series(dtype="Int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="Int64"), "near": pd.Series(dtype="bool")})]
            for ids, ns, pca, ids2, ns2, pca2, same in zip(pdf["ids"], pdf["ns"], pdf["pca"], pdf["ids2"], pdf["ns2"], pdf["pca2"], pdf["same"]):
                ids, ns, ids2, ns2 = (np.asarray(v, np.int64) for v in (ids, ns, ids2, ns2))
                x, y = (np.frombuffer(b"".join(b), np.float64).reshape(len(k), -1) for b, k in ((pca, ids), (pca2, ids2)))
                i, j, cosine = all_close_pairs(x, y, threshold, bool(same))
                near = np.abs(cosine - threshold) <= SLACK
                sure = ~near & (cosine >= threshold)
                found.append(pd.DataFrame({"a": ids[i[near]], "b": ids2[j[near]], "n": pd.NA, "near": True}))
                i, j = i[sure], j[sure]
                for own, at, other, weight in ((ids, i, j, ns2), (ids2, j, i, ns)):
                    sums = np.bincount(at, weight[other], len(own)).astype(np.int64)
                    found.append(pd.DataFrame({"a": own[sums > 0], "b": pd.NA, "n": sums[sums > 0], "near": False}))
                kept = forest(ids[i], ids2[j])
                found.append(pd.DataFrame({"a": ids[i[kept]], "b": ids2[j[kept]], "n": pd.NA, "near": False}))
            yield pd.concat([f.astype({"a": "Int64", "b": "Int64", "n": "Int64", "near": "bool"}) for f in found])

    return compare


def _verify(threshold: float):
    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [np.dot(np.frombuffer(u), np.frombuffer(v)) >= threshold for u, v in zip(pdf["u"], pdf["v"])]
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return exact


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors as bytes; rows that can't be compared have null."""
    for pdf in batches:
        out = []
        for v in pdf["_v"]:
            ok = v is not None and len(v) and not any(c is None for c in v)
            a = np.asarray(v, np.float64) if ok else None
            ok = ok and np.isfinite(a).all() and np.any(a != 0)
            out.append(unit(a[None])[0].tobytes() if ok else None)
        yield pd.DataFrame({"_id": pdf["_id"], "_label": pdf["_label"], "_u": out})


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second moments by label and number of dimensions, summed in each task."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for pdf in batches:
        for (label, dims), own in pdf.groupby(["_label", "_dims"]):
            x = np.frombuffer(b"".join(own["_u"]), np.float64).reshape(len(own), -1)
            sums[label, dims] = sums.get((label, dims), 0) + x.T @ x
    for (label, dims), s in sums.items():
        yield pd.DataFrame({"_label": [label], "_dims": [dims], "_m": [s.ravel().tolist()]})


def _rotate(own: pd.DataFrame, bases: pd.DataFrame) -> pd.DataFrame:
    """Coordinates of some vectors of a label on its axes, which come once for all of them."""
    columns = ["_class", "_n", "_label", "_dims"]
    if not len(own) or not len(bases):
        return pd.DataFrame({c: [] for c in [*columns, "_p", "_first"]})
    x = np.frombuffer(b"".join(own["_u"]), np.float64).reshape(len(own), -1)
    p = x @ np.frombuffer(bases["_axes"].iloc[0], np.float64).reshape(x.shape[1], -1)
    return own[columns].assign(_p=[r.tobytes() for r in p], _first=p[:, 0])


def _boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the least and largest coordinates of each tile on the leading axes."""
    for pdf in batches:
        boxes = [np.frombuffer(b"".join(p), np.float64).reshape(len(p), -1)[:, :BOX] for p in pdf["pca"]]
        yield pdf[["_label", "_dims", "_tile"]].assign(lo=[b.min(0) for b in boxes], hi=[b.max(0) for b in boxes])


def paired(tiles: DataFrame, threshold: float) -> DataFrame:
    """(_label, _dims, t1, t2): pairs of tiles that may hold a close pair; tiles: (_label, _dims, _tile, lo, hi).

    The distance of unit vectors is at least that of their boxes on any axes.  The
    tiles of a label are dealt over tasks: each meets the others in one of several parts.
    """
    sizes = tiles.groupBy("_label", "_dims").agg(F.expr("cast(1 + count(1) div 64 as int)").alias("_parts"))
    dealt = tiles.join(sizes, ["_label", "_dims"])
    one = dealt.select(
        "_label", "_dims", F.pmod(F.xxhash64("_tile"), F.col("_parts")).cast("int").alias("_part"),
        F.col("_tile").alias("t1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"),
    )
    two = dealt.select(
        "_label", "_dims", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part"),
        F.col("_tile").alias("t2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
    )
    gaps = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    apart = F.zip_with(gaps("lo2", "hi1"), gaps("lo1", "hi2"), lambda x, y: (x + y) * (x + y))
    distance = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x)
    near = one.join(two, ["_label", "_dims", "_part"]).filter((F.col("t1") <= F.col("t2")) & (distance <= max(0.0, 2 - 2 * threshold) + 1e-6))
    return near.select("_label", "_dims", "t1", "t2")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int | None = None) -> DataFrame:
    """One row per vector: the id, n_links (long), component_id (long), kept (boolean).

    Vectors link when their labels are equal and not null and their cosine, in double
    precision, is at least ``threshold`` (over 0).  Null, empty and zero vectors, and
    those with null or non-finite components, link with nothing, nor do vectors of
    different lengths.  n_links counts the other rows linked directly (rows that
    repeat, also under one id, count each); component_id is the smallest id reachable;
    a null id takes part in links and stands under null.  An empty table gives no rows.
    ``tile``: vectors of a tile; by default as many as have TILE_BYTES.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vector_col).cast("array<double>").alias("_v"))
    units = materialize(rows.mapInPandas(_units, "_id long, _label string, _u binary"), "vectors")
    usable = units.filter("_u is not null and _label is not null").withColumn("_dims", F.expr("cast(octet_length(_u) div 8 as int)"))
    # Equal unit vectors are one class; its links are counted with the rows of each class.
    # Rounding may set the cosine of a vector with itself below 1, never below a threshold away from it.
    classes = materialize(usable.groupBy("_label", "_dims", "_u").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least")).withColumn("_class", F.xxhash64("_label", "_u")), "vector-classes")
    sums = classes.select("_label", "_dims", "_u").mapInPandas(_moments, "_label string, _dims int, _m array<double>")
    moments = sums.select("_label", "_dims", F.posexplode("_m")).groupBy("_label", "_dims", "pos").agg(F.sum("col").alias("s")).groupBy("_label", "_dims").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("m"))

    def to_axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_label": pdf["_label"], "_dims": pdf["_dims"], "_axes": [np.ascontiguousarray(axes(np.array([c["s"] for c in m]).reshape(d, d))).tobytes() for m, d in zip(pdf["m"], pdf["_dims"])]})

    bases = materialize(moments.mapInPandas(to_axes, "_label string, _dims int, _axes binary"), "vector-axes")
    # The axes of a label go once to each part of its vectors, not to each vector.
    width = F.greatest(F.lit(1), F.lit(ROTATED_BYTES) / (8 * F.col("_dims")))
    parts = classes.groupBy("_label", "_dims").agg(F.count(F.lit(1)).alias("_c")).withColumn("_parts", F.ceil(F.col("_c") / width).cast("int"))
    salted = classes.join(parts, ["_label", "_dims"]).withColumn("_part", F.pmod("_class", F.col("_parts")).cast("int"))
    spread = bases.join(parts, ["_label", "_dims"]).select("_label", "_dims", "_axes", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part"))
    keys = ["_label", "_dims", "_part"]
    rotated = salted.select("_class", "_n", "_u", *keys).groupBy(*keys).cogroup(spread.groupBy(*keys))
    projected = materialize(rotated.applyInPandas(_rotate, "_class long, _n long, _label string, _dims int, _p binary, _first double"), "vector-projections")
    # Tiles: runs of classes of a label along its first axis, by exact quantile buckets of a range partitioning.
    line = [F.col(c) for c in ("_label", "_dims", "_first", "_class")]
    dealt = projected.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("_at", F.monotonically_increasing_id())
    per_tile = str(tile) if tile else f"greatest(1, {TILE_BYTES} div (8 * _dims))"
    dealt = dealt.withColumn("_tile", F.expr(f"_at div {per_tile}"))
    tiles = dealt.groupBy("_label", "_dims", "_tile").agg(F.sort_array(F.collect_list(F.struct("_class", "_n", "_p"))).alias("c"))
    tiles = materialize(tiles.select("_label", "_dims", "_tile", F.col("c._class").alias("ids"), F.col("c._n").alias("ns"), F.col("c._p").alias("pca")), "vector-tiles")
    boxes = tiles.select("_label", "_dims", "_tile", "pca").mapInPandas(_boxes, "_label string, _dims int, _tile long, lo array<double>, hi array<double>")
    near = paired(materialize(boxes, "vector-boxes"), threshold)
    first = tiles.select("_label", "_dims", F.col("_tile").alias("t1"), "ids", "ns", "pca")
    second = tiles.select("_label", "_dims", F.col("_tile").alias("t2"), *(F.col(c).alias(f"{c}2") for c in ("ids", "ns", "pca")))
    work = near.join(first, ["_label", "_dims", "t1"]).join(second, ["_label", "_dims", "t2"]).withColumn("same", F.col("t1") == F.col("t2"))
    found = materialize(work.select("ids", "ns", "pca", "ids2", "ns2", "pca2", "same").mapInPandas(_tile_pairs(threshold), "a long, b long, n long, near boolean"), "vector-pairs")
    raw = classes.select("_class", "_u")
    border = found.filter("near").join(raw.select(F.col("_class").alias("a"), F.col("_u").alias("u")), "a").join(raw.select(F.col("_class").alias("b"), F.col("_u").alias("v")), "b")
    verified = materialize(border.select("a", "b", "u", "v").mapInPandas(_verify(threshold), "a long, b long"), "vector-border")
    pairs = found.filter("not near and b is not null").select("a", "b").union(verified)
    both = verified.union(verified.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = found.filter("b is null").select("a", "n").union(both.join(classes.select(F.col("_class").alias("b"), F.col("_n").alias("n")), "b").select("a", "n"))
    links = counted.groupBy(F.col("a").alias("_class")).agg(F.sum("n").alias("_others"))
    joined = components(pairs).withColumnRenamed("node", "_class")
    least = joined.join(classes.select("_class", "_least"), "_class").groupBy("component").agg(F.min("_least").alias("_lowest"))
    judged = classes.join(links, "_class", "left").join(joined.join(least, "component"), "_class", "left").select("_label", "_dims", "_u", (F.col("_n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"), F.coalesce("_lowest", "_least").alias("component_id"))
    linked = usable.join(judged, ["_label", "_dims", "_u"]).select("_id", "n_links", "component_id")
    alone = units.filter("_u is null or _label is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.union(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
