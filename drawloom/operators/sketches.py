"""Approximate aggregates of any span of days from sketches that are made once.

Every day has a sketch of distinct values, one of quantiles and one of frequent items, as
binary columns that merge.  Runs of 2, 4, 8 .. days have the merged ones, so a span of
days is put together from at most two runs of each length, however long it is, and the rows
are read once, however many spans are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Logarithm of the buckets of the distinct sketch (an error of about 1.6 %), and the size parameter of the quantile sketch (about 1.3 % of the ranks).
LOG_BUCKETS, QUANTILE_SIZE = 12, 200
#: Items that the sketch of frequent items keeps at most.
ITEMS = 1_000
#: The longest run has 2 to the power of this many days (about 90 years).
LEVELS = 15


def day_sketches(rows: DataFrame, *, day: str, distinct: str, value: str, item: str, levels: int = LEVELS) -> DataFrame:
    """(_level, _cell, n, _distinct, _values, _items): the sketches of all runs of 2^_level days, written once.

    ``day``: a date; rows without one are left out, nulls of the other columns are counted in n alone.
    Partial sketches are made before the shuffle, a row a day and task.
    """
    number = F.unix_date(F.to_date(F.col(day)))
    given = rows.select(number.alias("_day"), F.col(distinct).alias("_d"), F.col(value).cast("double").alias("_v"), F.col(item).cast("string").alias("_i"))
    days = given.filter("_day is not null").groupBy("_day").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_d", LOG_BUCKETS).alias("_distinct"),
        F.kll_sketch_agg_double("_v", QUANTILE_SIZE).alias("_values"), F.expr(f"approx_top_k_accumulate(_i, {ITEMS})").alias("_items"),
    )
    days = materialize(days, "sketch-days").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    runs = days.withColumn("_cell", F.expr("shiftright(_day, _level)")).groupBy("_level", "_cell")
    return materialize(runs.agg(*merged()), "sketch-runs")


def merged() -> list[Column]:
    return [
        F.sum("n").alias("n"), F.hll_union_agg("_distinct", True).alias("_distinct"), F.kll_merge_agg_double("_values").alias("_values"),
        F.expr("approx_top_k_combine(_items)").alias("_items"),
    ]


def runs_of(first: str, last: str, levels: int = LEVELS) -> Column:
    """Array of (level, cell): runs of days that make up the days from ``first`` to ``last`` (day numbers), at most two a level below the longest."""
    step = f"""aggregate(sequence(0, {levels}), named_struct('a', {first}, 'b', {last}, 'o', cast(array() as array<struct<level:int,cell:int>>)), (s, l) -> named_struct(
        'a', if(l < {levels}, shiftright(s.a + 1, 1), s.a), 'b', if(l < {levels}, shiftright(s.b - 1, 1), s.b),
        'o', concat(s.o, if(s.a > s.b, array(), transform(
            if(l = {levels}, sequence(s.a, s.b), array_distinct(filter(array(if(s.a % 2 != 0, s.a, null), if(s.b % 2 = 0, s.b, null)), x -> x is not null))), x -> named_struct('level', l, 'cell', x))))), s -> s.o)"""
    return F.expr(step)


def over_spans(sketches: DataFrame, spans: DataFrame, *, quantiles: list[float], top: int = 5, levels: int = LEVELS) -> DataFrame:
    """span_id, n, distinct, quantiles (array<double>), top (array of item, count): of the days first_day to last_day of each span.

    ``spans``: (span_id, first_day, last_day), dates, both included.  Spans without a row
    of data, and those that end before they begin, give no row.
    """
    asked = spans.select("span_id", F.unix_date(F.to_date("first_day")).alias("_a"), F.unix_date(F.to_date("last_day")).alias("_b"))
    nodes = asked.select("span_id", F.explode(runs_of("_a", "_b", levels)).alias("_r")).select("span_id", F.col("_r.level").alias("_level"), F.col("_r.cell").alias("_cell"))
    found = nodes.join(sketches, ["_level", "_cell"]).groupBy("span_id").agg(*merged())
    at = F.array(*(F.kll_sketch_get_quantile_double("_values", F.lit(q)) for q in quantiles))
    return found.select("span_id", "n", F.hll_sketch_estimate("_distinct").alias("distinct"), at.alias("quantiles"), F.expr(f"approx_top_k_estimate(_items, {top})").alias("top"))
