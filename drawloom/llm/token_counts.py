"""Exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

#: Default vocabulary: a tiktoken rank file; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenising pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Adds each text's number of tokens; the vocabulary is loaded once in each task, on the executor."""

    def __init__(self, vocabulary: str, pattern: str, text_col: str) -> None:
        self.vocabulary, self.pattern, self.text_col = vocabulary, pattern, text_col

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(self.vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        count = tiktoken.Encoding("corpus", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            lengths = [len(count(t)) if t else 0 for t in texts_of(batch, self.text_col)]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != self.text_col]
            names = [name for name in batch.schema.names if name != self.text_col]
            yield pa.record_batch([*kept, pa.array(lengths, pa.int64())], names=[*names, "n_tokens"])


def encoded_lengths(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per document: the columns of ``keep`` and n_tokens (long).

    Whole texts are encoded; special-token strings are ordinary text; null and
    empty texts have 0 tokens; repeated rows count each.
    """
    keep = [c for c in keep or [] if c not in ("n_tokens", text_col)]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] if keep else []
    return arrow_map(docs.select(*keep, text_col), Encoder(vocabulary, pattern, text_col), ", ".join([*schema, "n_tokens long"]))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row for each length that occurs; partial counts before the shuffle.

    Rows that repeat count each; further columns play no part, also one named n_docs; a
    null length is a row of its own; an empty table gives no rows.
    """
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """Suffix and prefix sums of the histogram: the whole answer at every length that occurs.

    Columns: n_tokens (a length, taken as the context limit), n_docs, docs_le and
    docs_ge (documents at most, at least so long), tokens_ge (their tokens),
    truncated_total (tokens left if each document is cut to the limit), lost_tokens,
    docs_total, tokens_total and quantile (docs_le / docs_total).  Between two
    lengths that occur, truncated_total grows by docs_ge of the upper one for each
    token of the limit, so the table answers every limit.  Its size is the number of
    different lengths, bounded by the longest document and not by the corpus.  An
    empty corpus gives no rows.
    """
    down = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    h = histogram.select("n_tokens", F.col("n_docs").cast("long").alias("n_docs"), (F.col("n_tokens") * F.col("n_docs")).alias("_mass"))
    h = h.withColumns({"docs_ge": F.sum("n_docs").over(down), "tokens_ge": F.sum("_mass").over(down), "docs_total": F.sum("n_docs").over(everything), "tokens_total": F.sum("_mass").over(everything)})
    cut = F.col("tokens_total") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    le = F.col("docs_total") - F.col("docs_ge") + F.col("n_docs")
    return h.select("n_tokens", "n_docs", le.alias("docs_le"), "docs_ge", "tokens_ge", cut.alias("truncated_total"), (F.col("tokens_total") - cut).alias("lost_tokens"), "docs_total", "tokens_total", (le / F.col("docs_total")).alias("quantile"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if each document is cut to ``limit`` (0 for an empty corpus)."""
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit).cast("long")) * F.col("n_docs")), F.lit(0)).alias("truncated_total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents does not exceed (null if empty)."""
    return limits(histogram).filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def over_limit(limit: int) -> Column:
    """Whether a document is longer than the limit."""
    return F.col("n_tokens") > limit
