"""Draws made from the driver's order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import ranked


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw for each order with lines: the different l_partkey mod 37 + 1, in the order of date and key."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.pmod("l_partkey", F.lit(37)) + 1).cast("int").alias("n"))
    numbers = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("n")).alias("numbers"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = orders.join(numbers, F.col("o_orderkey") == F.col("l_orderkey"))
    placed = ranked(joined, F.col("o_orderdate"), F.col("o_orderkey"))
    return placed.select("ord", F.col("o_orderkey").cast("string").alias("draw_id"), "numbers", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


def numbers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(draw_id, numbers) of the same draws where positions don't matter: no ranking."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.pmod("l_partkey", F.lit(37)) + 1).cast("int").alias("n"))
    numbers = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("n")).alias("numbers"))
    return numbers.join(read(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("l_orderkey").cast("string").alias("draw_id"), "numbers")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of the entries table."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("message"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
