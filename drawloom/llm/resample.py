"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Features are runs of one and two words, hashed into buckets.  Tasks turn blocks of
documents into postings (bucket, document of the block, count), laid out by ranges of
buckets.  The postings of both corpora meet by bucket, where its gain is computed: the
logarithm of how much more often the target holds it.  The documents' postings are
then shuffled by range of buckets and run of blocks; each task there has the gains of its own
buckets only, adds up what they contribute to its documents, and emits one sum for each
document; the sums are reduced by document.  A bucket that all documents hold is many
rows of bounded size, dealt over as many tasks as its range has runs of blocks.
Gumbel noise from a hash of the id turns the weights into a draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD_TABLE, arrow_map, materialize
from .order import ranked

#: Buckets of features.
BUCKETS = 10_000
#: Ranges of buckets whose postings are shuffled together.
RANGES = 16
#: Features, and documents, after which a block of documents ends.
BLOCK_FEATURES, BLOCK_DOCS = 2_000_000, 60_000
#: Blocks of a range that go to one task.
RUN = 16
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20


def pieces_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about PIECE bytes at a time."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def bucket_counts(text: str, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and of the features of one and two words in each bucket."""
    n, counts, last = 0, np.zeros(buckets, np.int64), None
    for words in pieces_of(text.encode("utf-8", "surrogatepass").translate(WORD_TABLE)):
        if not words:
            continue
        one = list(map(crc32, words))
        # The sum of a word and a space goes on with the next word.
        spaced = list(map(crc32, repeat(b" "), one))
        two = map(crc32, words[1:], spaced)
        if last is not None:
            two = chain((crc32(words[0], last),), two)
        last, n = spaced[-1], n + len(words)
        counts += np.bincount(np.fromiter(chain(one, two), np.int64) % buckets, minlength=buckets)
    return n, counts


class Postings:
    """Blocks of documents as rows: one with the documents, and one for each range of buckets with its postings.

    Of a range: ``_n``, the features in each of its buckets; ``_held``, how many documents
    each of its buckets has (uint16); ``_at``, these documents' places in the block by bucket (uint16); ``_counts``
    (uint8, or uint32 where one is over 255).
    """

    def __init__(self, buckets: int, ranges: int, kind: pa.DataType) -> None:
        self.buckets, self.ranges, self.most = buckets, ranges, (BLOCK_FEATURES, BLOCK_DOCS)
        document = pa.struct([("id", kind), ("words", pa.int64()), ("features", pa.int64())])
        self.schema = pa.schema([
            ("_block", pa.int64()), ("_range", pa.int32()), ("_docs", pa.list_(document)), ("_n", pa.list_(pa.int64())),
            ("_held", pa.binary()), ("_at", pa.binary()), ("_counts", pa.binary()),
        ])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        docs, found, features = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, counts = bucket_counts(text.as_py() or "", self.buckets)
                total = max(2 * words - 1, 0)
                docs.append({"id": key, "words": words, "features": total})
                which = np.flatnonzero(counts)
                found.append((which, counts[which]))
                features += total
                if features >= self.most[0] or len(docs) >= self.most[1]:
                    yield self.rows(block, docs, found)
                    block, docs, found, features = block + 1, [], [], 0
        if docs:
            yield self.rows(block, docs, found)

    def rows(self, block: int, docs: list[dict], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket = np.concatenate([b for b, _ in found]).astype(np.int32)
        counts = np.concatenate([c for _, c in found])
        place = np.repeat(np.arange(len(found), dtype=np.uint16), [len(b) for b, _ in found])
        order = np.argsort(bucket, kind="stable")
        bucket, counts, place = bucket[order], counts[order], place[order]
        rows = [{"_block": block, "_range": None, "_docs": docs}]
        edges = [r * self.buckets // self.ranges for r in range(self.ranges + 1)]
        for r, (low, high) in enumerate(zip(edges, edges[1:])):
            own = slice(*np.searchsorted(bucket, (low, high)))
            if own.start == own.stop:
                continue
            b, c = bucket[own] - low, counts[own]
            rows.append({
                "_block": block, "_range": r, "_n": np.bincount(b, c, high - low).astype(np.int64).tolist(),
                "_held": np.bincount(b, minlength=high - low).astype(np.uint16).tobytes(), "_at": place[own].tobytes(),
                "_counts": c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes(),
            })
        return pa.RecordBatch.from_pylist(rows, self.schema)


def postings(docs: DataFrame, buckets: int, name: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of the blocks of ``docs``: (_block, _range, _docs, _n, _held, _at, _counts)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    made = arrow_map(
        rows, Postings(buckets, RANGES, to_arrow_type(rows.schema["_id"].dataType)),
        f"_block long, _range int, _docs array<struct<id:{kind},words:long,features:long>>, _n array<long>, "
        "_held binary, _at binary, _counts binary",
    )
    return materialize(made, name)


def totals(table: DataFrame, name: str) -> DataFrame:
    """(_range, _b, name): the features in each bucket that occurs, summed up before the shuffle."""
    each = table.filter("_range is not null").select("_range", F.posexplode("_n").alias("_b", "_c"))
    return each.filter("_c > 0").groupBy("_range", "_b").agg(F.sum("_c").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(_range, _b, _gain long) of each bucket that the source holds, from the postings of both corpora by bucket."""
    features = lambda t: t.select(F.explode("_docs").alias("d")).agg(F.coalesce(F.sum("d.features"), F.lit(0)))
    # Two numbers, one a corpus.
    all_source, all_target = (features(t).first()[0] for t in (source, target))
    met = totals(source, "_s").join(totals(target, "_t"), ["_range", "_b"], "left")
    s, t = F.col("_s").cast("double"), F.coalesce("_t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(float(all_source + buckets)) / ((s + 1) * F.lit(float(all_target + buckets)))
    return met.select("_range", "_b", F.floor(1000 * F.log(ratio)).cast("long").alias("_gain"))


def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, _doc, _sum): what the buckets of each row contribute to each of its documents."""
    for batch in batches:
        blocks, places, sums = [], [], []
        for row in batch.to_pylist():
            held, at = np.frombuffer(row["_held"], np.uint16), np.frombuffer(row["_at"], np.uint16)
            width = len(row["_counts"]) // max(len(at), 1)
            counts = np.frombuffer(row["_counts"], np.uint8 if width == 1 else np.uint32)
            gain = np.zeros(len(held), np.int64)
            gain[row["_places"]] = row["_gains"]
            # Whole numbers far below 2**53, so their sums in doubles are exact.
            total = np.bincount(at, np.repeat(gain, held) * counts).astype(np.int64)
            own = np.flatnonzero(np.bincount(at))
            blocks.append(np.full(len(own), row["_block"]))
            places.append(own.astype(np.int32))
            sums.append(total[own])
        if blocks:
            columns = [pa.array(np.concatenate(c)) for c in (blocks, places, sums)]
            yield pa.record_batch(columns, names=["_block", "_doc", "_sum"])


def contributions(source: DataFrame, gain: DataFrame) -> DataFrame:
    """(_block, _doc, _sum): the gains of all features of each document, its postings shuffled by bucket."""
    runs = source.filter("_range is not null").select(
        "_range", F.expr(f"_block div {RUN}").alias("_run"), "_block", "_held", "_at", "_counts"
    )
    # The buckets of a range as two arrays, once for each run of blocks that has postings there.
    listed = gain.groupBy("_range").agg(F.collect_list("_b").alias("_places"), F.collect_list("_gain").alias("_gains"))
    dealt = runs.select("_range", "_run").distinct().join(listed, "_range")
    met = runs.join(dealt.hint("merge"), ["_range", "_run"])
    met = met.select("_block", "_held", "_at", "_counts", "_places", "_gains")
    sums = arrow_map(met, contribute, "_block long, _doc int, _sum long")
    return sums.groupBy("_block", "_doc").agg(F.sum("_sum").alias("_sum"))


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, seed: int = 7,
    buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per document: the id, n_features, weight, score, rank (all long but the id).

    weight is the floored mean of the gains, in thousandths, of a document's features (0
    without any); score adds Gumbel noise that a hash of ``seed`` and the id gives, so the
    draw is the same at each run.  Of the documents with ``least_words`` words or more the
    ``percent`` hundredths (rounded down) of highest scores are drawn; rank numbers them
    from 1, ties to the smaller id, and is null for the others.

    Null texts are empty, empty ones have no features; a null id hashes as ``null`` and
    comes last among ties; rows that repeat are documents of their own, with ranks in the
    order in which they are stored; an empty target gives gains all the same (T is 0), an
    empty table no rows; further columns play no part.
    """
    source = postings(docs, buckets, "postings", id_col=id_col, text_col=text_col)
    texts = target.select(F.lit(0).alias("doc"), F.col(target_text_col).alias("text"))
    wanted = postings(texts, buckets, "target-postings", id_col="doc")
    sums = contributions(source, gains(source, wanted, buckets))
    listed = source.select("_block", F.posexplode("_docs").alias("_doc", "_d"))
    scored = listed.join(sums, ["_block", "_doc"], "left")
    n = F.col("_d.features")
    floored = F.expr("(coalesce(_sum, 0) - pmod(coalesce(_sum, 0), _d.features)) div _d.features")
    weight = F.when(n > 0, floored).otherwise(F.lit(0))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_d.id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scored.select(
        "_block", "_doc", F.col("_d.id").alias("_key"), F.col("_d.words").alias("_words"), n.alias("_features"),
        weight.cast("long").alias("_weight"), (weight + noise).cast("long").alias("_score"),
    )
    scored = materialize(scored, "resample-scores")
    enough = F.col("_words") >= least_words
    # The place of a document in the table parts what ties in score and id.
    keys = [F.col("_score").desc(), F.col("_key").asc_nulls_last(), F.col("_block"), F.col("_doc")]
    drawn = scored.filter(enough).count() * percent // 100
    number = F.when(F.col("_rank") < drawn, F.col("_rank") + 1)
    lined = ranked(scored.filter(enough), keys, "resample-ranks").withColumn("rank", number).drop("_rank")
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    named = [F.col("_key").alias(id_col), *(F.col(f"_{c}").alias(c) for c in ("weight", "score"))]
    return lined.unionByName(rest).select(named[0], F.col("_features").alias("n_features"), *named[1:], "rank")
