"""Schemas of the tables and the error classes."""

from __future__ import annotations

from pyspark.sql import types as T

#: ``ord`` is the position of a draw, from 0 without gaps: order is data here, never the date.
DRAWS = T.StructType([T.StructField("ord", T.LongType(), False), T.StructField("draw_id", T.StringType(), False), T.StructField("numbers", T.ArrayType(T.IntegerType(), False), False), T.StructField("date", T.StringType(), True)])
ENTRIES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("message", T.StringType(), False), T.StructField("created_at", T.StringType(), False)])


class DatasetError(Exception):
    """A dataset can't be read or split."""


class InvalidDrawError(DatasetError):
    """A draw breaks a rule."""


class GeneratorError(Exception):
    """Candidate scores can't give a ticket."""


class OptimizerError(Exception):
    """A ticket can't be optimized."""


class SelectionError(Exception):
    """Nothing can be selected."""


class RecommendationError(Exception):
    """Nothing can be recommended."""


class BacktestError(Exception):
    """A backtest can't be run."""


class EntryError(Exception):
    """An entry can't be stored now."""


class BaselineError(Exception):
    """A baseline can't be drawn."""
