"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import WRITTEN, clear_tables, materialize, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by the Spark reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words_table() -> bytes:
    """Byte table: A-Z to a-z; digits, a-z and all bytes of non-ASCII code points stay; the rest become spaces."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            out[b] = b
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


WORD_TABLE = ascii_words_table()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """The rows as one struct ``_row``, so that no column of theirs can clash, beside the expressions of ``extra``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(e.alias(n) for n, e in extra.items()))


def unpacked(df: DataFrame, *more: str | Column) -> DataFrame:
    """The columns of packed rows again, and ``more``."""
    return df.select("_row.*", *more)


#: Most rows of an Arrow batch between the JVM and Python: documents are long, and both sides hold whole batches.
BATCH_ROWS = 1000


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows, which is set for the session unless it has fewer."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a worker holds stays small; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of [start, start+length) for each pair, concatenated."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(np.asarray(starts, np.int64), lengths)


#: Rows that a table may have to be broadcast: some tens of MB.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which is counted first, else with a merge hint."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


#: Bits of a membership filter: its table is 4 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 25


def flagged(rows: DataFrame, key: Column, keys: DataFrame, member: Column, name: str = "_maybe") -> DataFrame:
    """``rows`` plus a boolean: false only where ``key`` is not among the ``member`` values of ``keys``.

    A bitmap of hashed keys of fixed size is broadcast, so rows that can't match needn't
    be shuffled for a join.  With many more keys than bits it lets everything through,
    which costs the shuffle and never a match.
    """
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(FILTER_BITS)) + 1
    maps = keys.select(bit(member).alias("_x")).groupBy(F.bitmap_bucket_number("_x").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_x")).alias("_bits"))
    place = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(_byte, cast(_place % 8 as int)) & 1") == 1
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit(key)) == F.col("_bucket"), "left").withColumns({"_byte": F.coalesce(byte, F.lit(0)), "_place": place})
    return joined.withColumn(name, held).drop("_bucket", "_bits", "_byte", "_place")
