"""Exact global and per-group ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize


def ranked(df: DataFrame, keys: list[Column], name: str, within: str | None = None) -> DataFrame:
    """``df`` with ``_rank`` (from 0, gapless) in the order of ``keys``; ``within``: ranks start anew for each of its values.

    The rows are dealt by ranges of the keys, so the keys should end in something
    that splits a hot group and rows that repeat, as the place where a stored row is read.  Each partition numbers its rows; what lies before a
    partition comes from a table with a row for each partition (and value of
    ``within`` in it), which is broadcast only if it is small.  The numbered rows
    are written to the shared folder first, as a repeated sampling could deal them
    otherwise.  ``within`` must be the first key.
    """
    number = "shiftright(_id, 33)", "_id & 8589934591L"
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    held = materialize(dealt, name)
    held = held.withColumns({"_part": F.expr(number[0]).cast("int"), "_at": F.expr(number[1].replace("L", ""))})
    by = ["_part", *([within] if within else [])]
    counts = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    counts = materialize(counts, f"{name}-parts")
    group = [within] if within else []
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    starts = counts.select(F.col("_part").alias("_part2"), *(F.col(c).alias("_within2") for c in group), shift)
    same = F.col("_part") == F.col("_part2")
    if within:
        same &= F.col(within).eqNullSafe(F.col("_within2"))
    rank = (F.col("_at") + F.col("_shift")).alias("_rank")
    return held.join(broadcast_if_small(starts), same).select(*(f"`{c}`" for c in df.columns), rank)
