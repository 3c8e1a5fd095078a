"""Ordered sets of draws: validity, positions, appending, walk-forward splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..schema import DRAWS, DatasetError, InvalidDrawError
from .running import running, running_lists
from .stats import recency_of


def draw_error() -> Column:
    """Why a draw is not valid, by the first rule it breaks; null if it is valid."""
    numbers = F.col("numbers")
    return (
        F.when(F.coalesce(F.col("draw_id"), F.lit("")) == "", F.lit("draw_id cannot be empty"))
        .when(F.coalesce(F.size(numbers), F.lit(0)) <= 0, F.lit("A draw must contain at least one number"))
        .when(F.exists(numbers, lambda x: x.isNull()), F.lit("All lottery numbers must be integers"))
        .when(F.exists(numbers, lambda x: x <= 0), F.lit("Lottery numbers must be positive"))
        .when(F.size(F.array_distinct(numbers)) != F.size(numbers), F.lit("Lottery numbers must be unique"))
    )


def check_draws(df: DataFrame) -> None:
    """Raise for the first draw, by ord, that is not valid; one job."""
    bad = df.select("ord", draw_error().alias("e")).filter("e is not null").agg(F.min_by("e", "ord").alias("e")).first()
    if bad.e is not None:
        raise InvalidDrawError(bad.e)


class DrawDataset:
    """An immutable, ordered set of draws over a DataFrame (ord, draw_id, numbers, date)."""

    def __init__(self, frame: DataFrame) -> None:
        self.draws = frame

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple], *, validate: bool = True) -> DrawDataset:
        """From (draw_id, numbers[, date]) tuples in their order."""
        listed = [(i, r[0], list(r[1]), r[2] if len(r) > 2 else None) for i, r in enumerate(rows)]
        made = cls(spark.createDataFrame(listed, DRAWS))
        if validate:
            check_draws(made.draws)
        return made

    def __len__(self) -> int:
        return self.draws.count()

    def __iter__(self) -> Iterator[Row]:
        return self.draws.orderBy("ord").toLocalIterator()

    def __getitem__(self, index: int | slice) -> Row | DataFrame:
        """The draw at a position (negative: from the end); a slice gives the DataFrame of its rows."""
        if isinstance(index, slice):
            at = range(*index.indices(len(self)))
            low, high = (min(at), max(at)) if len(at) else (0, -1)
            return self.draws.filter(F.col("ord").between(low, high) & ((F.col("ord") - low) % abs(at.step) == 0)).orderBy(F.col("ord").asc() if at.step > 0 else F.col("ord").desc())
        wanted = index if index >= 0 else len(self) + index
        row = self.draws.filter(F.col("ord") == wanted).first() if wanted >= 0 else None
        if row is None:
            raise IndexError("draw index out of range")
        return row

    def append(self, draw_id: str, numbers: Iterable[int], date: str | None = None) -> DrawDataset:
        """A new dataset with one more draw at the end; this one stays as it is."""
        spark = self.draws.sparkSession
        one = spark.createDataFrame([(0, draw_id, list(numbers), date)], DRAWS)
        check_draws(one)
        return DrawDataset(append_draw(self.draws, one))

    def latest(self) -> Row:
        row = latest_draw(self.draws).first()
        if row is None:
            raise DatasetError("Dataset is empty")
        return row


def append_draw(draws: DataFrame, one: DataFrame) -> DataFrame:
    """``draws`` and the row of ``one`` behind them."""
    end = draws.agg(F.coalesce(F.max("ord") + 1, F.lit(0).cast("long")).alias("_end"))
    return draws.select("ord", "draw_id", "numbers", "date").unionByName(one.drop("ord").join(end).select(F.col("_end").alias("ord"), "draw_id", "numbers", "date"))


def latest_draw(draws: DataFrame) -> DataFrame:
    """The row of the last position; no row for an empty set."""
    return draws.orderBy(F.col("ord").desc()).limit(1)


@dataclass(frozen=True)
class WalkForward:
    """Expanding splits: split k trains on the first train_size + k * test_size draws and tests on the next test_size."""

    draws: DataFrame
    train_size: int
    test_size: int = 1
    n: int | None = None  # the number of draws, if it is known

    def __post_init__(self) -> None:
        if self.train_size <= 0:
            raise ValueError("train_size must be positive")
        if self.test_size <= 0:
            raise ValueError("test_size must be positive")
        if self.n is None:
            object.__setattr__(self, "n", self.draws.count())
        if self.train_size + self.test_size > self.n:
            raise DatasetError("train_size + test_size exceeds dataset size")

    @property
    def n_splits(self) -> int:
        return (self.n - self.train_size) // self.test_size

    def test_rows(self) -> DataFrame:
        """The draws of all test blocks with split_id; a last block that isn't full is left out."""
        block = F.expr(f"cast((ord - {self.train_size}) div {self.test_size} as int)")
        return self.draws.filter((F.col("ord") >= self.train_size) & (F.col("ord") < self.train_size + self.n_splits * self.test_size)).withColumn("split_id", block)

    def splits(self) -> DataFrame:
        """split_id, train_size, test_size: a row for each split."""
        ids = self.draws.sparkSession.range(self.n_splits).select(F.col("id").cast("int").alias("split_id"))
        return ids.select("split_id", (F.lit(self.train_size) + F.col("split_id") * self.test_size).cast("long").alias("train_size"), F.lit(self.test_size).cast("long").alias("test_size"))

    def train_statistics(self) -> DataFrame:
        """split_id, number, count, last_ord (of the latest training row with the number); numbers not seen are absent.

        Every draw is exploded once.  A draw counts from the first split that trains on
        it, and counts and last positions are carried along the splits in two levels, so
        the work follows draws + rows of the result, with a split for each draw too.
        """
        return running(self._events(), "number", "split_id", self.n_splits - 1, total="count", latest="last_ord")

    def _events(self) -> DataFrame:
        """split_id, number, count, last_ord of the draws that a split trains on and the one before it doesn't."""
        first = F.expr(f"cast(greatest(0, (ord - {self.train_size}) div {self.test_size} + if(ord < {self.train_size}, 0, 1)) as int)")
        new = self.draws.select(first.alias("split_id"), "ord", F.explode("numbers").alias("number")).filter(F.col("split_id") < self.n_splits)
        return new.groupBy("number", "split_id").agg(F.count(F.lit(1)).alias("count"), F.max("ord").alias("last_ord"))

    def train_lists(self) -> DataFrame:
        """split_id, seen: a row for each split, the array of its (number, count), ascending; the counts of ``train_frequency``."""
        return running_lists(self._events(), "number", "split_id", self.n_splits - 1, "count")

    def train_frequency(self) -> DataFrame:
        """split_id, number, count over the training rows; numbers not seen are absent."""
        return self.train_statistics().select("split_id", "number", "count")

    def train_recency(self) -> DataFrame:
        """split_id, number, count, gap (training draws since the number was last seen, 0: in the last one), recency 1 / (1 + gap)."""
        gap = F.lit(self.train_size - 1) + F.col("split_id").cast("long") * self.test_size - F.col("last_ord")
        return self.train_statistics().select("split_id", "number", "count", gap.alias("gap")).withColumn("recency", recency_of("gap"))
