"""Joins along time: the latest row before, and points inside intervals; both are equi-joins with bounded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def as_of(points: DataFrame, history: DataFrame, *, at: str, since: str, by: list[str] | None = None, ties: list[str] | None = None, name: str = "latest") -> DataFrame:
    """``points`` plus ``name``: the row of ``history`` (a struct) with the largest ``since`` up to their ``at``; null if there is none.

    ``by``: columns of both that must be equal, null with null; ``ties``: columns of ``history`` of which the
    largest decides between rows of one time.  Points without a time have no such row.

    Both sides become one line, dealt by ranges of (by, time), and the last row of the
    history is carried along it: inside a range by a window, and from the ranges before by
    a table of a row for each range and ``by`` in it.  So a hot ``by`` is dealt over many
    tasks, and no row is compared with more than its neighbours.
    """
    by, ties = by or [], ties or []
    keys = [f"_k{i}" for i in range(len(by))]
    own = lambda df: [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
    row = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    empty = lambda df: F.lit(None).cast(df.select(row(df).alias("r")).schema["r"].dataType)
    order = F.struct(*(F.col(f"`{c}`") for c in ties)) if ties else F.struct(F.lit(0).alias("_none"))
    no_order = F.lit(None).cast(history.select(order.alias("o")).schema["o"].dataType)
    seen = history.filter(F.col(since).isNotNull()).select(*own(history), F.col(since).alias("_t"), F.lit(0).alias("_kind"), order.alias("_o"), row(history).alias("_past"), empty(points).alias("_point"))
    asked = points.select(*own(points), F.col(at).cast(history.schema[since].dataType).alias("_t"), F.lit(1).alias("_kind"), no_order.alias("_o"), empty(history).alias("_past"), row(points).alias("_point"))
    # A number of the stored row parts what ties in everything else.
    stored = materialize(seen.union(asked).withColumn("_row", F.monotonically_increasing_id()), "as-of-rows")
    line = [*(F.col(k) for k in keys), F.col("_t"), F.col("_kind"), F.col("_o"), F.col("_row")]
    dealt = stored.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("_at", F.monotonically_increasing_id())
    held = materialize(dealt.drop("_o", "_row"), "as-of-line").withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = held.filter("_kind = 0").groupBy("_part", *keys).agg(F.max_by("_past", "_at").alias("_end"))
    parts = held.select("_part", *keys).distinct()
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    joined = parts.alias("p").join(ends.alias("e"), _all([F.col("p._part") == F.col("e._part"), *same("p", "e")]), "left").select("p.*", "e._end")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = joined.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    found = held.withColumn("_own", F.last("_past", ignorenulls=True).over(inside)).filter("_kind = 1")
    met = found.alias("f").join(carried.alias("c"), _all([F.col("f._part") == F.col("c._part"), *same("f", "c")]))
    latest = F.when(F.col("f._t").isNotNull(), F.coalesce("f._own", "c._carry"))
    return met.select("f._point", latest.alias("_latest")).select("_point.*", F.col("_latest").alias(name))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def within(points: DataFrame, intervals: DataFrame, *, at: str, begin: str, end: str) -> DataFrame:
    """Columns of both for every point whose ``at`` lies in an interval, ends included; whole numbers, such as microseconds.

    An interval belongs to the level of the power of two that it is no longer than, and
    is copied to the one or two cells of that width that it touches; a point is looked
    up in its cell of each level that occurs, of which there are some tens at most.  So
    neither a long interval nor many short ones make more copies.  Intervals that end
    before they begin, and nulls, meet nothing.
    """
    length = F.col(end) - F.col(begin)
    level = F.when(length <= 1, F.lit(0)).otherwise(F.ceil(F.log2(length.cast("double"))).cast("int") + 1)
    sound = intervals.filter(length >= 0).withColumn("_level", level)
    used = [r[0] for r in sound.select("_level").distinct().collect()]
    copied = sound.withColumn("_cell", F.explode(F.array_distinct(F.array(_cell(begin), _cell(end)))))
    levels = F.array(*(F.lit(x) for x in sorted(used))) if used else F.array().cast("array<int>")
    asked = points.withColumn("_level", F.explode(levels)).withColumn("_cell", _cell(at))
    met = asked.join(copied, ["_level", "_cell"]).filter(F.col(at).between(F.col(begin), F.col(end)))
    return met.drop("_level", "_cell")


def _cell(c: str) -> Column:
    """The cell of a place at the row's level."""
    return F.expr(f"shiftright(cast(`{c}` as bigint), _level)")
