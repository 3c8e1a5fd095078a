"""Number counts kept up to date while draws arrive; all other operators work on finite sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.stats import number_counts


def running_counts(draws: DataFrame) -> DataFrame:
    """number, count over a streaming DataFrame of draws, for the complete or update output mode; the state is a row per number."""
    return number_counts(draws)
