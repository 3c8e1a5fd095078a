"""Connected components with DataFrame joins: no edge or component is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: Edges that a task contracts at once.
CHUNK = 1_000_000
#: There are fewer centres than this: nodes with more than their share of all edges. They are broadcast.
CENTRES = 10_000
#: Neighbours that a centre has at least.
DEGREE = 400


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): for each node that isn't the least one of its component in these edges, that one."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        # Labels are roots here: the larger one of an edge is hung on the smaller.
        x, y = label[x], label[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


class Forests:
    """Edges (u, v), u > v, that connect what each ``chunk`` of the edges of a task connects: one for each node but the least."""

    def __init__(self, chunk: int) -> None:
        self.chunk = chunk

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= self.chunk:
                yield self.contracted(held)
                held = []
        yield self.contracted(held)

    def contracted(self, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
        return pa.record_batch([pa.array(x, pa.int64()) for x in forest(a, b)], names=["u", "v"])


def told(rows: DataFrame, seen: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with m of ``seen`` (u, m, d) by u.

    Nodes of more than edges / CENTRES rows, which are fewer than CENTRES, are
    broadcast with their m, so no task gets all the neighbours of a hub; the others are joined.
    """
    most = max(DEGREE, edges // CENTRES)
    centres = seen.filter(F.col("d") > most).select(F.col("u").alias("_u"), F.col("m").alias("_m"))
    split = rows.join(F.broadcast(centres), F.col("u") == F.col("_u"), "left")
    near = split.filter("_u is null").select("u", "v").join(seen.filter(F.col("d") <= most).select("u", "m"), "u")
    return split.filter("_u is not null").select("u", "v", F.col("_m").alias("m")).unionByName(near)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable; edges: (a, b) longs, nulls not allowed.

    Each task contracts its edges by union-find first.  Then star rounds alternate: each
    node's larger neighbours, then each node's smaller ones, are linked to its smallest
    neighbour, and tasks contract again, until every edge points to the smallest node of
    its component.  Self-loops and repeated edges don't matter; no edges give no rows.
    """
    contract = lambda df: materialize(arrow_map(df, Forests(CHUNK), "u long, v long"), "components")
    now = contract(edges.select("a", "b"))
    while True:
        out = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lower, upper = F.when(F.col("v") < F.col("u"), F.col("v")), F.count_if(F.col("v") > F.col("u"))
        seen = out.groupBy("u").agg(F.min(lower).alias("lo"), F.max(lower).alias("hi"), upper.alias("upper"), F.count(F.lit(1)).alias("d"))
        seen = materialize(seen.withColumn("m", F.coalesce("lo", "u")), "components-least")
        size, unfinished = seen.agg(F.sum("d"), F.count_if((F.col("lo") < F.col("hi")) | (F.col("lo").isNotNull() & (F.col("upper") > 0)))).first()
        if not unfinished:
            star = now.distinct()
            roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour, or the node itself.
        large = told(out, seen, size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "components-large")
        # Small star: the smaller neighbours of a node, and itself, go to the smallest of them.
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")), "components-down")
        small = told(large, down, size).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = contract(small.union(down.select("u", F.col("m").alias("v"))).distinct())
