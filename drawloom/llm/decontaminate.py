"""Benchmark decontamination by suffix arrays over the training texts.

Each shard (the documents of some Arrow batches) has the suffix array of its word
sequence.  It is built a word at a time: the suffixes of an interval, which agree so
far, are sorted by their next word, and the suffixes of the benchmark that lie in the
interval are binary-searched among them.  Only intervals with a suffix of the
benchmark are sorted further.  Where a suffix of the benchmark finds no interval any
more its longest verbatim match ends, and the interval before holds its locations.
Windows of ``window`` words (an item of fewer words is one window) that have an
interval mark the words they cover; equal windows share it, so each is handled once.
The benchmark is the stated query set: it goes to the shards in blocks whose size is
measured first, and no shuffle takes place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, arrow_map, materialize, packed, ranges, unpacked

#: Most bytes of benchmark text sent to the executors at once; larger benchmarks go in several blocks.
BLOCK_BYTES = 32 << 20
#: Words that one suffix array holds.
SHARD_WORDS = 2_000_000


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of digits, a-z and code points from U+0080 on."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class Queries:
    """One block of benchmark items: vocabulary, words, and for each suffix its item and the length of its window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        rank = {name: i for i, name in enumerate(self.names)}
        flat: list[int] = []
        item: list[int] = []
        length: list[int] = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            n = min(window, len(ids))
            flat += [*ids, 0]
            item += [rank[name]] * (len(ids) + 1)
            length += [n if i + n <= len(ids) else 0 for i in range(len(ids))] + [0]
        self.words = np.array(flat, np.int64)
        self.item, self.length = np.array(item, np.int64), np.array(length, np.int64)
        self.suffixes = np.flatnonzero(self.words)
        self.lengths = set(np.unique(self.length).tolist()) - {0}


def search(ids: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(longest, hits, items) of one shard; ids: 0 for words outside the benchmark, between the texts and at the end.

    longest: words of the longest match with the benchmark that begins at each place;
    hits: rows (start, words, window) of places of windows; items: those of each window.
    """
    longest = np.zeros(len(ids), np.int32)
    found, items = [np.zeros((3, 0), np.int64)], []
    size = len(queries.vocabulary) + 1
    # Suffixes in the order of the array, and the interval of each; those of the benchmark likewise.
    at, interval = np.flatnonzero(ids), np.zeros(int(np.count_nonzero(ids)), np.int64)
    asked, asked_in = queries.suffixes, np.zeros(len(queries.suffixes), np.int64)
    depth = 0
    while len(at) and len(asked):
        key = interval * size + ids[at + depth]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        ends = queries.words[asked + depth] > 0
        asked, asked_in = asked[ends], asked_in[ends]
        wanted, which = np.unique(asked_in * size + queries.words[asked + depth], return_inverse=True)
        low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        # Intervals that hold suffixes of both sides are numbered anew.
        held = high > low
        number = np.cumsum(held) - 1
        at = at[ranges(low[held], (high - low)[held])]
        interval = np.repeat(np.arange(int(held.sum())), (high - low)[held])
        asked, asked_in = asked[held[which]], number[which[held[which]]]
        depth += 1
        longest[at] = depth
        if depth in queries.lengths and len(asked):
            whole = queries.length[asked] == depth
            pairs = np.unique(np.stack([asked_in[whole], queries.item[asked[whole]]]), axis=1)
            windows, first = np.unique(pairs[0], return_index=True)
            place = np.searchsorted(windows, interval)
            hit = np.isin(interval, windows)
            start = at[hit]
            found.append(np.stack([start, np.full(len(start), depth), place[hit] + len(items)]))
            items += np.split(pairs[1], first[1:]) if len(windows) else []
    return longest, np.concatenate(found, axis=1), items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint spans, flat."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


class Marker:
    """Adds the matches of one block of items to rows that carry ``_spans``, ``_items`` and ``_longest``."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, column: str) -> None:
        self.items, self.window, self.column = items, window, column

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(self.items, self.window)
        get = queries.vocabulary.get
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, end, total = [], at, 0
                column = batch.column(batch.schema.get_field_index(self.column))
                while end < batch.num_rows and total < SHARD_WORDS:
                    found = words(column[end].as_py())
                    texts.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
                    total += len(found) + 1
                    end += 1
                yield self.shard(batch.slice(at, end - at), texts, queries)
                at = end

    def shard(self, batch: pa.RecordBatch, texts: list[np.ndarray], queries: Queries) -> pa.RecordBatch:
        gap = np.zeros(1, np.int64)
        ids = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        longest, (start, n, window), items_of = search(ids, queries)
        owner = np.searchsorted(begin, start, "right") - 1
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        spans, items = columns["_spans"].to_pylist(), columns["_items"].to_pylist()
        for k in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[k] : cuts[k + 1]]
            own = set(zip((start[rows] - begin[k]).tolist(), (start[rows] - begin[k] + n[rows]).tolist()))
            own |= set(zip(spans[k][::2], spans[k][1::2]))
            spans[k] = merged(list(own))
            named = np.unique(np.concatenate([items_of[w] for w in np.unique(window[rows])]))
            items[k] = sorted({*items[k], *(queries.names[i] for i in named)})
        most = np.maximum.reduceat(longest, begin[:-1]) if texts else np.zeros(0, np.int32)
        most = np.maximum(most, columns["_longest"].to_numpy(zero_copy_only=False))
        columns |= {
            "_spans": pa.array(spans, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string())),
            "_longest": pa.array(most, pa.int64()), "_words": pa.array([len(t) for t in texts], pa.int64()),
        }
        return pa.record_batch([columns[x] for x in batch.schema.names], names=batch.schema.names)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus what the benchmark's windows hit in them.

    Added columns: ``_words`` (long, words of the text), ``_spans`` (array<int>,
    starts and ends of disjoint hit runs, in words), ``_items`` (array<string>, ids
    of items with a window in it, sorted as strings) and ``_longest`` (long, words of
    the longest run that some item has, too, be it shorter than a window).  Null and empty texts have no words and no hits;
    items that share an id count as one; a null id is written ``null``.  Rows that
    repeat are handled alike, ties do not arise, an empty table gives no rows; other
    columns pass through, and columns of the four added names are replaced.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = int(-(-size // block_bytes)) or 1
    out = docs.withColumns({"_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<int>"), "_items": F.array().cast("array<string>"), "_longest": F.lit(0).cast("long")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    for b in range(blocks):
        rows = [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toLocalIterator()]
        out = arrow_map(out, Marker(rows, window, text_col), schema)
        if b + 1 < blocks:
            out = materialize(out, f"decontaminate-{b}")
    return out


def hit_words(spans: str = "_spans") -> Column:
    """Words inside the spans."""
    return F.expr(f"aggregate({spans}, 0, (a, x) -> x - a)").cast("long")


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, hit_spans."""
    m = match_benchmark(docs.select("doc_id", "text"), benchmark, window=window)
    return m.select(
        "doc_id", F.col("_words").alias("n_words"), hit_words().alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"), F.col("_longest").alias("longest_match"), F.array_join(F.col("_spans").cast("array<string>"), ",").alias("hit_spans"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; same columns.

    Null and empty texts and texts without words stay, rows that repeat go or stay
    alike, an empty table gives no rows, and no column of ``docs`` can clash.
    """
    return unpacked(match_benchmark(packed(docs, text=F.col("text").cast("string")), benchmark, window=window).filter(F.size("_spans") == 0))
