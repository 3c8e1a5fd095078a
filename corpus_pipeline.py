"""A pipeline over the documents table: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents.  Every stage gives no rows for an empty table; null and empty texts,
null ids and repeated rows follow the docstrings of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawloom.llm import decontaminate, jaccard, mixing, sharding, toxicity
from drawloom.llm.common import materialize, table
from drawloom.llm.labelled import held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the classifier is fitted on the labelled documents that aren't held out."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held=held_out(4, 2))
    return toxicity.remove_toxic(docs, model, threshold=0.3)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are mixed to weights of the square root of their sizes."""
    return mixing.mixed_order(docs.select(*COLUMNS), key=[F.xxhash64("doc_id"), F.col("doc_id")])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; documents of a source move together as far as the shards stay even, and slots follow the mixed order."""
    return sharding.shard_documents(docs, shards=8, group=F.col("source")).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("pfair_mixing", mix_sources),
    ("label_propagation_shards", shard),
]

#: A trained classifier decides in the first stage, so SQL can't give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
