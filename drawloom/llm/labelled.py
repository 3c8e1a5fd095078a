"""Bounded samples of labelled documents, which the two classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text has this remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, max_rows: int) -> DataFrame:
    """(_id, _text, _y): at most ``max_rows`` rows, each a labelled document that is not held out.

    The ids come in the order of a hash, so the choice is the same at each run and
    unbiased; a document with several labels has the label of their majority (1 on a
    tie); null labels and ids don't count.  Of several documents with one id that of
    the smallest hash of its text stands for all, a null text as an empty one, so
    ``max_rows`` bounds what is broadcast and what the driver later gets.  The texts
    are written once to the shared folder.
    """
    voted = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held)
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
        .withColumn("_order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)))
    )
    # Far fewer labels than there may be reach the one task that sorts them.
    total = voted.count()
    share = (max_rows + 10 * max_rows**0.5 + 100) / max(total, 1)
    if share < 1:
        voted = voted.filter(F.col("_order") < int((1 << 62) * share))
    chosen = voted.orderBy("_order", "doc_id").limit(max_rows)
    ids = chosen.select(F.col("doc_id").alias("_id"), "_y")
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    joined = texts.join(F.broadcast(ids), "_id").groupBy("_id", "_y")
    one = joined.agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("_least"))
    return materialize(one.select("_id", "_y", F.col("_least._text").alias("_text")), f"labelled-{label}")
