"""The engine from SQL: views of a set of draws, and table functions over any table of draws."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .operators import stats

#: Columns that walk_forward adds to those of its table.
ADDED = (StructField("split_id", IntegerType()), StructField("split_train_size", LongType()), StructField("split_test_size", LongType()))


class WalkForwardRows:
    """``walk_forward(TABLE(t), train_size, test_size, draw_count)``: the test rows of all splits.

    The table has a column ``ord`` (positions from 0); its columns come back, and behind
    them split_id, split_train_size and split_test_size.  A row decides for itself, so the table is
    handled where it lies, in as many tasks as it has partitions; of ``draw_count`` draws a last
    block that isn't full is left out, as are rows without a position.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, train_size: AnalyzeArgument, test_size: AnalyzeArgument, draw_count: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "ord" not in table.dataType.fieldNames():
            raise ValueError("walk_forward needs a table with the column ord")
        for name, given in (("train_size", train_size), ("test_size", test_size)):
            if not given.isConstantExpression or given.value is None or given.value <= 0:
                raise ValueError(f"{name} must be a positive number")
        twice = {f.name for f in ADDED} & set(table.dataType.fieldNames())
        if twice:
            raise ValueError(f"columns that walk_forward adds are in the table: {', '.join(sorted(twice))}")
        return AnalyzeResult(StructType([*table.dataType.fields, *ADDED]))

    def eval(self, row: Row, train_size: int, test_size: int, draw_count: int) -> Iterator[tuple]:
        at = row["ord"]
        if at is not None and train_size <= at < draw_count:
            split = (at - train_size) // test_size
            if train_size + (split + 1) * test_size <= draw_count:
                yield (*row, split, train_size + split * test_size, test_size)


class NumbersOfDraws:
    """``draw_numbers(TABLE(t))``: a row (ord, number) for each number of each draw."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not {"ord", "numbers"} <= set(table.dataType.fieldNames()):
            raise ValueError("draw_numbers needs a table with the columns ord and numbers")
        return AnalyzeResult(StructType([StructField("ord", LongType()), StructField("number", IntegerType())]))

    def eval(self, row: Row) -> Iterator[tuple]:
        for number in row["numbers"] or []:
            yield row["ord"], number


def register(spark: SparkSession, draws: DataFrame | None = None) -> None:
    """The table functions of this session, and with ``draws`` the views draws, number_frequency and number_gaps."""
    # Pickled rows: with Arrow, Spark makes a table of its own of what each row yields, which costs more than the row.
    spark.udtf.register("walk_forward", udtf(WalkForwardRows, useArrow=False))
    spark.udtf.register("draw_numbers", udtf(NumbersOfDraws, useArrow=False))
    if draws is not None:
        draws.createOrReplaceTempView("draws")
        stats.number_frequency(draws).createOrReplaceTempView("number_frequency")
        stats.number_gaps(draws).createOrReplaceTempView("number_gaps")
