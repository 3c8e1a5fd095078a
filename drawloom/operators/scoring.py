"""Weighted scores of numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import largest_count


@dataclass(frozen=True)
class NumberPredictor:
    """Scores from relative frequency and recency, which the caller supplies."""

    frequency_weight: float = 0.7
    recency_weight: float = 0.3

    def __post_init__(self) -> None:
        if self.frequency_weight < 0:
            raise ValueError("frequency_weight cannot be negative")
        if self.recency_weight < 0:
            raise ValueError("recency_weight cannot be negative")
        if self.frequency_weight + self.recency_weight == 0:
            raise ValueError("At least one weight must be positive")

    def score_numbers(self, frequencies: DataFrame, recency: DataFrame | None = None, by: list[str] | None = None, *, check: bool = True) -> DataFrame:
        """(by..., number, score); frequencies: (by..., number, count), recency: (number, recency), 0 where absent,
        with the columns of ``by`` where it differs between them.

        Without ``by`` in the order of the numbers.  No rows give no rows; a negative
        count is an error.
        """
        by = by or []
        if check and frequencies.filter("count < 0").limit(1).count():
            raise ValueError("Frequencies cannot be negative")
        if recency is not None:
            on = [c for c in [*by, "number"] if c in recency.columns]
            frequencies = frequencies.join(recency.select(*on, F.col("recency").cast("double").alias("_recency")), on, "left")
        scored = self.with_scores(frequencies, by, None if recency is None else "_recency").select(*by, "number", "score")
        return scored if by else scored.orderBy("number")

    def with_scores(self, frequencies: DataFrame, by: list[str], recency: str | None = None) -> DataFrame:
        """``frequencies`` (by..., number, count, ...) plus score; recency: a column of theirs, null as 0."""
        share = F.col("count").cast("double") / largest_count(by).cast("double")
        recent = F.lit(0.0) if recency is None else F.coalesce(F.col(recency), F.lit(0.0))
        fw, rw = F.lit(float(self.frequency_weight)), F.lit(float(self.recency_weight))
        return frequencies.withColumn("score", (fw * share + rw * recent) / (fw + rw))

    def rank_numbers(self, frequencies: DataFrame, recency: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
        """The scores plus rank: best first, ties by number."""
        scores = self.score_numbers(frequencies, recency, by)
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.col("score").desc(), "number")))
