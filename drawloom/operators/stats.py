"""Number-frequency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import with_previous


def dataset_statistics(draws: DataFrame) -> DataFrame:
    """One row: draw_count, number_count, minimum, maximum (null for no draws); no explode."""
    return draws.agg(F.count(F.lit(1)).alias("draw_count"), F.coalesce(F.sum(F.size("numbers")), F.lit(0)).cast("long").alias("number_count"), F.min(F.array_min("numbers")).alias("minimum"), F.max(F.array_max("numbers")).alias("maximum"))


def lottery_summary(draws: DataFrame) -> DataFrame:
    """One row: draw_count, total_numbers, minimum_number, maximum_number."""
    return dataset_statistics(draws).select("draw_count", F.col("number_count").alias("total_numbers"), F.col("minimum").alias("minimum_number"), F.col("maximum").alias("maximum_number"))


def number_counts(draws: DataFrame) -> DataFrame:
    """number, count of every number seen; partial counts before the shuffle."""
    return draws.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("count"))


def number_frequency(draws: DataFrame) -> DataFrame:
    """number, count, frequency, by number; frequency: the share of all numbers drawn (not of the draws)."""
    share = F.col("count") / F.sum("count").over(Window.partitionBy())
    return number_counts(draws).withColumn("frequency", share).orderBy("number")


def frequency_for(frequency: DataFrame, number: int) -> DataFrame:
    """The row of a number; no row if it was never seen."""
    return frequency.filter(F.col("number") == number)


def most_frequent(frequency: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` most frequent numbers, ties by number; none for a limit of 0 or less."""
    return frequency.orderBy(F.col("count").desc(), "number").limit(max(limit, 0))


def least_frequent(frequency: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` least frequent of the numbers seen, ties by number."""
    return frequency.orderBy("count", "number").limit(max(limit, 0))


def largest_count(by: list[str]) -> Column:
    """The largest count within ``by``, 1 if that is less."""
    return F.greatest(F.max("count").over(Window.partitionBy(*by)), F.lit(1))


def recency_of(gap: str) -> Column:
    """1 for a number of the latest draw, falling towards 0 with the draws since."""
    return F.lit(1.0) / (F.lit(1.0) + F.col(gap).cast("double"))


def number_gaps(draws: DataFrame) -> DataFrame:
    """ord, number, gap: for every number of every draw the draws since it was last seen (0: in the one before), null at first.

    ``draws``: (ord, numbers); ord from 0.  Carried over blocks of draws, so no task has a number's whole history.
    """
    last = draws.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    seen = with_previous(draws.select("ord", F.explode("numbers").alias("number")), "number", "ord", last, "_before")
    return seen.select("ord", "number", (F.col("ord") - F.col("_before") - 1).alias("gap"))


def number_recency(draws: DataFrame) -> DataFrame:
    """number, gap (draws after the number's last one), recency (1 / (1 + gap)): what score_numbers takes; partial maxima before the shuffle."""
    size = draws.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    last = draws.select("ord", F.explode("numbers").alias("number")).groupBy("number").agg(F.max("ord").alias("_last"))
    return last.select("number", (F.lit(size) - F.col("_last")).alias("gap")).withColumn("recency", recency_of("gap"))


def frequency_cube(draws: DataFrame, sets: list[list[str]]) -> DataFrame:
    """number, year, month, grouping, count: the numbers of (numbers, date) by each of several sets of these columns, in one pass.

    Columns that are not in a row's set are null there, and ``grouping`` has their bits (number 4, year 2, month 1);
    a draw without a date has null year and month of its own.  The rows are expanded
    before the partial counts, so the shuffle has the groups and not the draws.
    """
    date = F.to_date("date")
    each = draws.select(F.explode("numbers").alias("number"), F.year(date).alias("year"), F.month(date).alias("month"))
    columns = [F.col(c) for c in ("number", "year", "month")]
    grouped = each.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.grouping_id(*columns).cast("int").alias("grouping"), F.count(F.lit(1)).alias("count")).select("number", "year", "month", "grouping", "count")


def pair_cube(draws: DataFrame) -> DataFrame:
    """first, second, year, grouping, count: pairs of numbers drawn together, by year (grouping 0), in all (1), and numbers of pairs in all (7)."""
    pairs = F.transform("numbers", lambda a: F.transform(F.filter("numbers", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second"))))
    each = draws.select(F.explode(F.flatten(pairs)).alias("p"), F.year(F.to_date("date")).alias("year")).select("p.first", "p.second", "year")
    columns = [F.col(c) for c in ("first", "second", "year")]
    grouped = each.groupingSets([columns, columns[:2], []], *columns)
    return grouped.agg(F.grouping_id(*columns).cast("int").alias("grouping"), F.count(F.lit(1)).alias("count")).select("first", "second", "year", "grouping", "count")
