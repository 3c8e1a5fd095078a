"""Positions, running sums and last values along an order, in two levels, so that no task has a whole history."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, written

#: Rows that a table may have to be broadcast: some tens of MB.
BROADCAST_ROWS = 200_000


def sent(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if it has few rows, which is counted first, else merged."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def ranked(df: DataFrame, *keys: Column, name: str = "ord") -> DataFrame:
    """``df`` plus ``name`` (long), its position from 0 in the order of the keys; rows that tie in any order.

    The rows are dealt by ranges of the keys, and by a number of the stored row behind
    them, so neither a hot value of the first key nor a row that repeats is one task.
    They are numbered where they lie; the rows before a partition come from a table of
    a row for each partition.  Both steps are written, as a second sampling of the
    ranges could deal the rows otherwise.
    """
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "ranked-rows")
    line = [*keys, F.col("_row")]
    dealt = stored.repartitionByRange(*line).sortWithinPartitions(*line)
    held = materialize(dealt.withColumn("_line", F.monotonically_increasing_id()), "ranked-line")
    held = held.withColumns({"_part": F.shiftright("_line", 33), "_at": F.col("_line").bitwiseAND((1 << 33) - 1)})
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.join(sent(starts), "_part").select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + F.col("_at")).cast("long").alias(name))


def width_of(last: int) -> int:
    """Places of a block: as many as there are blocks, so that both levels are short."""
    return isqrt(max(last, 0)) + 1


def running(events: DataFrame, by: str, at: str, last: int, *, total: str, latest: str) -> DataFrame:
    """(by, at, total, latest) at every place from a value's first event to ``last``.

    ``events``: one row for each ``by`` and ``at`` (0..last); ``total`` is summed up and
    ``latest`` the largest so far.  A block of places has its sum; what lies before a
    block comes from the blocks, and within it from its own events.  A result stays
    the same from an event to the next one, so rows are made from such spans, at most
    a block long.  Work follows events + rows, and no task has more than a value's
    blocks or a block's events.
    """
    width = width_of(last)
    block = F.expr(f"cast(`{at}` div {width} as int)")
    kept = events.select(F.col(by).alias("_by"), F.col(at).cast("int").alias("_x"), block.alias("_block"), F.col(total).alias("_n"), F.col(latest).alias("_v"))
    blocks = kept.groupBy("_by", "_block").agg(F.sum("_n").alias("_n"), F.max("_v").alias("_v"), F.min("_x").alias("_first"))
    along = Window.partitionBy("_by").orderBy("_block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({
        "_carry": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_seen": F.max("_v").over(before),
        "_next": F.coalesce(F.lead("_block").over(along), F.lit(last // width + 1)),
    })
    end = F.least((F.col("_block") + 1) * width - 1, F.lit(last))
    ahead = blocks.filter("_seen is not null").select("_by", (F.col("_block") * width).alias("_low"), (F.col("_first") - 1).alias("_high"), F.col("_carry").alias("_n"), F.col("_seen").alias("_v"))
    idle = blocks.filter("_next > _block + 1").select("_by", F.explode(F.expr("sequence(_block + 1, _next - 1)")).alias("_block"), (F.col("_carry") + F.col("_n")).alias("_n"), F.greatest("_seen", "_v").alias("_v"))
    idle = idle.select("_by", (F.col("_block") * width).alias("_low"), end.alias("_high"), "_n", "_v")
    inside = Window.partitionBy("_by", "_block").orderBy("_x")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = kept.select("_by", "_block", "_x", F.sum("_n").over(so_far).alias("_n"), F.max("_v").over(so_far).alias("_v"), F.lead("_x").over(inside).alias("_later"))
    own = own.join(blocks.select("_by", "_block", "_carry", "_seen"), ["_by", "_block"])
    own = own.select("_by", F.col("_x").alias("_low"), F.coalesce(F.col("_later") - 1, end).alias("_high"), (F.col("_carry") + F.col("_n")).alias("_n"), F.greatest("_seen", "_v").alias("_v"))
    spans = ahead.union(idle).union(own).filter("_low <= _high")
    each = spans.select(F.col("_by").alias(by), F.explode(F.expr("sequence(cast(_low as int), cast(_high as int))")).alias(at), "_n", "_v")
    return each.select(by, at, F.col("_n").alias(total), F.col("_v").alias(latest))


def running_lists(events: DataFrame, by: str, at: str, last: int, total: str) -> DataFrame:
    """(at, seen): at every place from 0 to ``last`` the array of (by, total so far), ascending, without what has not come yet.

    ``events``: one row for each ``by`` and ``at`` (0..last), totals over 0.  Two levels
    as in ``running``: a block of places takes the sums before it, a row for each ``by``,
    and adds up its own events.  No row is made for each ``by`` and place.
    """
    width = width_of(last)
    kept = events.select(F.expr(f"cast(`{at}` div {width} as int)").alias("_block"), F.col(at).cast("int").alias("_x"), F.col(by).cast("int").alias("_by"), F.col(total).cast("long").alias("_n"))
    path, read = written(kept, "running-events"), events.sparkSession.read.schema(kept.schema)
    sums = read.parquet(path).groupBy("_block", "_by").agg(F.sum("_n").alias("_n"))
    grid = events.sparkSession.range(last // width + 1).select(F.col("id").cast("int").alias("_block")).crossJoin(sums.select("_by").distinct())
    before = Window.partitionBy("_by").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(sums, ["_block", "_by"], "left").select("_block", "_by", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))

    def listed(key: tuple, own: pa.Table, carry: pa.Table) -> pa.Table:
        low = key[0].as_py() * width
        places = min(width, last + 1 - low)
        numbers, place = np.unique(np.concatenate([carry["_by"].to_numpy(), own["_by"].to_numpy()]), return_inverse=True)
        sums = np.zeros((places, len(numbers)), np.int64)
        np.add.at(sums, (0, place[: len(carry)]), carry["_n"].to_numpy())
        np.add.at(sums, (own["_x"].to_numpy() - low, place[len(carry) :]), own["_n"].to_numpy())
        np.cumsum(sums, axis=0, out=sums)
        there = sums > 0
        pairs = pa.StructArray.from_arrays([pa.array(numbers[np.nonzero(there)[1]], pa.int32()), pa.array(sums[there], pa.int64())], [by, total])
        ends = pa.array(np.concatenate(([0], np.cumsum(there.sum(1)))), pa.int32())
        return pa.table({at: pa.array(np.arange(low, low + places), pa.int32()), "seen": pa.ListArray.from_arrays(ends, pairs)})

    both = read.parquet(path).groupBy("_block").cogroup(carried.groupBy("_block"))
    return both.applyInArrow(listed, f"`{at}` int, seen array<struct<`{by}`: int, `{total}`: bigint>>")


def with_previous(rows: DataFrame, by: str, at: str, last: int, name: str) -> DataFrame:
    """``rows`` plus ``name``: the place of the row of the same ``by`` before it, null for the first; places differ within ``by``.

    Within a block by a window; a block's first row takes the last place of the blocks before.
    """
    blocked = rows.withColumn("_block", F.expr(f"cast(`{at}` div {width_of(last)} as int)"))
    ends = blocked.groupBy(by, "_block").agg(F.max(at).alias("_end"))
    ends = ends.select(by, "_block", F.lag("_end").over(Window.partitionBy(by).orderBy("_block")).alias("_carried"))
    inside = F.lag(at).over(Window.partitionBy(by, "_block").orderBy(at))
    return blocked.withColumn("_own", inside).join(ends, [by, "_block"]).withColumn(name, F.coalesce("_own", "_carried")).drop("_block", "_own", "_carried")
