"""Draws from a CSV file, in file order, checked as a whole."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.draws import DrawDataset, draw_error
from ..operators.running import sent
from ..schema import DatasetError
from ..storage import materialize
from . import csv_lines


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def parsed_numbers(c: Column) -> Column:
    """Integers between commas or semicolons in their order, empty parts left out; null elements for parts that aren't integers."""
    parts = F.filter(F.transform(F.split(F.translate(c, ";", ","), ","), stripped), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("int")))


@dataclass(frozen=True)
class CsvDatasetLoader:
    """UTF-8 CSV with a header; further columns are ignored, the date may be missing.

    ``separator`` is accepted and has no effect: the delimiter is always a comma.  A
    byte order mark is skipped.  Of columns with one name the last counts.  Numbers
    are ASCII integers of 32 bits.

    ``split``: lines are scanned by many tasks (``csv_lines``), and ``path`` may be a
    folder of files with equal headers, whose draws follow each other in the order of the file names.
    A closing quote must then be followed by a comma or the end of the line.
    """

    draw_id_column: str = "draw_id"
    numbers_column: str = "numbers"
    date_column: str = "date"
    separator: str = ","
    split: bool = False

    def load(self, spark: SparkSession, path: str) -> DrawDataset:
        """The draws with ord; one job checks them and the first bad row is raised."""
        where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            raise DatasetError(f"Dataset file not found: {path}")
        if fs.getFileStatus(where).isDirectory() and not self.split:
            raise DatasetError(f"Could not read dataset file: {path}")
        try:
            raw, names = self.records(spark, str(path))
            rows = self.rows(raw, names)
            bad = rows.filter("error is not null").agg(F.min_by("error", "ord").alias("e"), F.min("ord").alias("o")).first()
        except (AnalysisException, PySparkException) as broken:
            raise DatasetError(f"Could not read dataset file: {path}") from broken
        if bad.e is not None:
            raise DatasetError(f"Invalid row {bad.o + 2}: {bad.e}")
        return DrawDataset(rows.drop("error"))

    def records(self, spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
        """The records as strings with ``_id`` (from 1 without gaps), and the header."""
        if self.split:
            return self.split_records(spark, path)
        # A file that is one partition numbers its records without gaps.
        raw = spark.read.option("header", False).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
        head = raw.first() if raw.columns else None
        if head is None:
            raise DatasetError("CSV file has no header")
        names = [x or "" for x in head]
        self.check_columns(names)
        return raw.withColumn("_id", F.monotonically_increasing_id()).filter("_id > 0"), names

    def split_records(self, spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
        """The same from files whose lines many tasks scan; the first record of each file is its header."""
        found = materialize(csv_lines.records(spark, path), "csv-records")
        headers = [r._text for r in found.filter("_record = 0").select("_text").distinct().limit(2).collect()]
        if not headers:
            raise DatasetError("CSV file has no header")
        if len(headers) > 1:
            raise DatasetError(f"Could not read dataset file: {path}")
        self.check_columns(names := next(csv.reader(io.StringIO(headers[0], newline=""))))
        rows = found.filter("_record > 0")
        counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        placed = rows.join(sent(starts), "_file").select((F.col("_before") + F.col("_record")).alias("_id"), "_text")
        return csv_lines.fields(placed, len(names)), names

    def check_columns(self, names: list[str]) -> None:
        missing = sorted({self.draw_id_column, self.numbers_column} - set(names))
        if missing:
            raise DatasetError(f"Missing CSV columns: {', '.join(missing)}")

    def rows(self, raw: DataFrame, names: list[str]) -> DataFrame:
        """(ord, draw_id, numbers, date, error)."""
        last = {n: f"_c{i}" for i, n in enumerate(names)}
        text = stripped(F.col(last[self.numbers_column]))
        date = F.nullif(stripped(F.col(last[self.date_column])), F.lit("")) if self.date_column in last else F.lit(None).cast("string")
        made = raw.select((F.col("_id") - 1).alias("ord"), stripped(F.col(last[self.draw_id_column])).alias("draw_id"), parsed_numbers(text).alias("numbers"), date.alias("date"), text.alias("_text"))
        parse = F.when(F.col("_text") == "", F.lit("numbers cannot be empty")).when(F.exists("numbers", lambda x: x.isNull()), F.lit("numbers must contain integers"))
        return made.withColumn("error", F.coalesce(parse, draw_error())).drop("_text")
