"""Exact repeats of long byte strings, found on a Burrows-Wheeler transform.

A string of ``length`` bytes that stands at two places has the same smallest k-gram
hash (anchor) at both, at the same distance.  The windows around an anchor are taken in
blocks of BLOCK starts; all windows of a block share a core of length - BLOCK + 1
bytes.  The hash of the core is the key of a shard: cores that stand at one place only
can't lie in a repeat and go no further.  The others send the bytes left and right of
the core (the wings), unless all places of a core have the same wings: their windows
all repeat.

In a shard the wings on the right are sorted, and the transform is extended backwards
over the wings on the left, breadth first: step d takes the column of characters d
bytes before the core, orders the rows by it (stably, as last-to-first mapping does)
and derives the common prefix of neighbours as one more than the least one in between
in the step before.  Common prefixes grow by one a step and are followed no further
than ``length`` bytes, at which a window is known to repeat.

A shard with more than HOT different items is cut in two by lengthening its core: the
earlier half of its windows share more bytes on the left, the later half on the right.
The halves are shards of the same kind, with shorter wings, so they go through the
transform too, and are cut again as long as they are large; in the end a core is a
whole window, of which there is one item only.  So no group is ever unbounded.
Texts that are equal are one text; all of their windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, flagged, materialize, pieces, texts_of

#: Windows of a block.
BLOCK = 192
#: Bytes of an anchor.
GRAM = 16
#: Different items beyond which a shard is cut.
HOT = 4096
_U = np.uint64


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A 39-bit hash of the GRAM bytes at each place."""
    h = a.astype(_U)
    span = 1
    while span < GRAM:
        h = (h[:-span] * _U(0x9E3779B97F4A7C15) + h[span:]) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        span *= 2
    return (h * _U(0x94D049BB133111EB)) >> _U(25)


def anchors(a: np.ndarray, length: int) -> np.ndarray:
    """The place of the leftmost smallest gram in each window of ``length`` bytes."""
    width = length - GRAM + 1
    out = []
    step = 1 << 23
    for at in range(0, len(a) - length + 1, step):
        piece = a[at : at + step + length - 1]
        h = gram_hashes(piece)
        m = ((h << _U(24)) | np.arange(len(h), dtype=_U)).view(np.int64)
        span = 1
        while 2 * span <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if width > span:
            m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
        out.append((m & ((1 << 24) - 1)) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def blocks(raw: bytes, length: int, block: int = BLOCK) -> np.ndarray:
    """The place of the core of each block of windows; the core has length - block + 1 bytes."""
    if len(raw) < length:
        return np.zeros(0, np.int64)
    at = anchors(np.frombuffer(raw, np.uint8), length)
    ahead = (at - np.arange(len(at))) // block
    key = at - ahead * block
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    return np.unique(key[new])


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


def wings_of(raw: bytes, place: int, size: int, wing: int) -> tuple[int, int, bytes, bytes]:
    """Hashes of a core and of core and wings together (both signed), and the wings."""
    core = xxhash.xxh3_64_intdigest(raw[place : place + size])
    left, right = raw[max(0, place - wing) : place], raw[place + size : place + size + wing]
    return signed(core), signed(xxhash.xxh3_64_intdigest(len(left).to_bytes(2, "little") + left + right, core)), left, right


class Cores:
    """(core, item, key, n, places) of the blocks of each different text of a task: one row for all places of an item."""

    def __init__(self, length: int, block: int) -> None:
        self.length, self.block = length, block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        size, wing = self.length - self.block + 1, self.block - 1
        kind = pa.schema([("_core", pa.int64()), ("_item", pa.int64()), ("_key", pa.int64()), ("_n", pa.int32()), ("_places", pa.list_(pa.int32()))])
        for batch in pieces(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text, key in zip(texts_of(batch, "_text"), batch.column(batch.schema.get_field_index("_key")).to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                raw = text.encode("utf-8", "surrogatepass")
                own: dict[tuple[int, int], list[int]] = {}
                for p in blocks(raw, self.length, self.block).tolist():
                    own.setdefault(wings_of(raw, p, size, wing)[:2], []).append(p)
                for (core, item), places in own.items():
                    for values, v in zip(rows, (core, item, key, len(raw), places)):
                        values.append(v)
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(rows, kind)], schema=kind)


class Wings:
    """(core, item, left, right) of the wanted places of each different text of a task."""

    def __init__(self, length: int, block: int) -> None:
        self.length, self.block = length, block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        size, wing = self.length - self.block + 1, self.block - 1
        kind = pa.schema([("_core", pa.int64()), ("_item", pa.int64()), ("_left", pa.binary()), ("_right", pa.binary())])
        for batch in pieces(batches):
            rows: tuple[list, ...] = ([], [], [], [])
            names = batch.schema.names
            for text, key, places in zip(texts_of(batch, "_text"), batch.column(names.index("_key")).to_pylist(), batch.column(names.index("_places")).to_pylist()):
                if key in seen or not places:
                    continue
                seen.add(key)
                raw = text.encode("utf-8", "surrogatepass")
                for p in places:
                    for values, v in zip(rows, wings_of(raw, p, size, wing)):
                        values.append(v)
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(rows, kind)], schema=kind)


def extend(core: np.ndarray, left: list[bytes], right: list[bytes], many: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (0 to block - 1) of each item that another item of its core, or a copy of its own, shares; -1 if none.

    many: whether an item stands at several places.  Window w covers the last
    block - 1 - w bytes of the left wing, the core, and w bytes of the right wing.
    """
    n, wing = len(core), block - 1
    first, last = np.full(n, -1), np.full(n, -1)
    left_size = np.array([len(x) for x in left], np.int64)
    right_size = np.array([len(x) for x in right], np.int64)
    # Bytes as matrices: left wings end at the core, right wings begin there.
    l_bytes = np.frombuffer(b"".join(x.rjust(wing, b"\0") for x in left), np.uint8).reshape(n, wing) if wing else np.zeros((n, 0), np.uint8)
    r_bytes = np.frombuffer(b"".join(x.ljust(wing, b"\0") for x in right), np.uint8).reshape(n, wing) if wing else np.zeros((n, 0), np.uint8)
    # Column 0 of the transform: rows in the order of core and right wing, and the common prefix with the row before.
    order = np.array(sorted(range(n), key=lambda i: (core[i], right[i])), np.int64)
    a, b = order[:-1], order[1:]
    differs = np.concatenate([r_bytes[a] != r_bytes[b], np.ones((len(a), 1), bool)], axis=1).argmax(1)
    prefix = np.full(n, -1, np.int16)
    prefix[1:] = np.where(core[a] == core[b], np.minimum(differs, np.minimum(right_size[a], right_size[b])), -1)
    single = np.flatnonzero(many & (wing - left_size <= right_size))
    first[single] = np.maximum(0, wing - left_size[single])
    last[single] = np.minimum(wing, right_size[single])
    for d in range(block):
        # A row's window at this step repeats if a neighbour's prefix has grown to all bytes beyond the core.
        hit = prefix >= wing
        found = order[hit | np.append(hit[1:], False)]
        w = wing - d
        first[found] = np.where(first[found] < 0, w, np.minimum(first[found], w))
        last[found] = np.maximum(last[found], w)
        if d == wing:
            break
        # Rows alone in their interval, or at the end of their left wing, can't be extended.
        alone = (prefix < 0) & np.append(prefix[1:] < 0, True)
        keep = ~alone & (left_size[order] > d)
        prefix = _least_between(prefix, np.flatnonzero(keep))
        order = order[keep]
        if len(order) < 2:
            break
        # One step back: the column of characters d + 1 before the core; equal ones stay in order.
        column = l_bytes[order, wing - 1 - d]
        by = np.argsort(column, kind="stable")
        prefix = _least_between(prefix, by)
        same = column[by][1:] == column[by][:-1]
        grown = prefix[1:]
        prefix = np.append(np.int16(-1), np.where(same & (grown >= 0), grown + 1, -1)).astype(np.int16)
        order = order[by]
    return first, last


def _least_between(prefix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For consecutive entries i < j of ``rows``, the least of prefix[i + 1 .. j]; -1 where they don't rise."""
    out = np.full(len(rows), -1, prefix.dtype)
    if len(rows) < 2:
        return out
    i, j = rows[:-1], rows[1:]
    gap = j - i
    ok = gap > 0
    # Intervals end where a prefix is -1: a gap that spans one needs no exact value.
    dead = np.cumsum(prefix < 0)
    ok &= dead[np.maximum(j, 0)] == dead[i]
    table, span, result = prefix, 1, np.full(len(i), -1, prefix.dtype)
    longest = int(gap[ok].max()) if ok.any() else 0
    while span <= longest:
        now = ok & (gap >= span) & (gap < 2 * span)
        result[now] = np.minimum(table[i[now] + 1], table[j[now] - span + 1])
        table = np.minimum(table[:-span], table[span:]) if 2 * span <= longest else table
        span *= 2
    out[1:] = result
    return out


class Shards:
    """(core, item, first, last) of the items with repeated windows; rows come sorted by core, a core's items together."""

    def __init__(self, block: int) -> None:
        self.block = block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            core = table.column("_core").to_numpy()
            cut = int(np.flatnonzero(core != core[-1])[-1]) + 1 if (core != core[-1]).any() else 0
            if cut:
                yield self.shard(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield self.shard(pa.Table.from_batches(held))

    def shard(self, table: pa.Table) -> pa.RecordBatch:
        core, item = table.column("_core").to_numpy(), table.column("_item").to_numpy()
        first, last = extend(core, table.column("_left").to_pylist(), table.column("_right").to_pylist(), table.column("_many").to_numpy() > 1, self.block)
        hit = first >= 0
        return pa.record_batch([pa.array(core[hit]), pa.array(item[hit]), pa.array(first[hit].astype(np.int32)), pa.array(last[hit].astype(np.int32))], names=["_core", "_item", "_first", "_last"])


def extended(items: DataFrame, block: int) -> DataFrame:
    """(_core, _item, _first, _last) of the items with repeated windows; items: (_core, _item, _left, _right, _many)."""
    dealt = items.repartition("_core").sortWithinPartitions("_core")
    return arrow_map(dealt, Shards(block), "_core long, _item long, _first int, _last int")


def halves(items: DataFrame, block: int) -> DataFrame:
    """Items of shards whose cores are longer: each item's earlier and later windows, as far as the text reaches.

    ``items`` and the result: (_core0, _item0, _base, _core, _item, _left, _right,
    _many); _base: the first window that the wings stand for, counted in the windows of
    (_core0, _item0).
    """
    half = -(-block // 2)
    more, wing = block - half, half - 1
    left, right = F.octet_length("_left"), F.octet_length("_right")
    part = lambda c, start, size: F.substring(F.col(c), start, size)
    near = F.greatest(left - more, F.lit(0))  # bytes of the left wing before those that the core takes
    cut = lambda start: F.greatest(start, F.lit(0)).cast("int")
    earlier = items.filter(left >= more).select(
        "_core0", "_item0", "_base", "_many", F.lit(0).alias("_side"), "_core",
        part("_left", cut(near - wing) + 1, F.least(near, F.lit(wing))).alias("_left"),
        part("_right", F.lit(1), F.lit(wing)).alias("_right"),
        part("_left", cut(near) + 1, F.lit(more)).alias("_taken"),
    )
    later = items.filter(right >= more).select(
        "_core0", "_item0", (F.col("_base") + more).alias("_base"), "_many", F.lit(1).alias("_side"), "_core",
        part("_left", cut(left - wing) + 1, F.lit(wing)).alias("_left"),
        part("_right", F.lit(more + 1), F.lit(wing)).alias("_right"),
        part("_right", F.lit(1), F.lit(more)).alias("_taken"),
    )
    longer = earlier.unionByName(later).withColumn("_core", F.xxhash64("_core", "_side", "_taken")).drop("_side", "_taken")
    # The length of one wing tells where the other begins.
    item = F.xxhash64("_core", F.octet_length("_left"), "_left", "_right")
    return longer.withColumn("_item", item)


def cut_shards(hot: DataFrame, block: int) -> DataFrame:
    """(_core, _item, _first, _last) of the items of shards with more than HOT items."""
    found = []
    now = hot.select(F.col("_core").alias("_core0"), F.col("_item").alias("_item0"), F.lit(0).alias("_base"), "_core", "_item", "_left", "_right", "_many")
    while True:
        now, block = materialize(halves(now, block), "repeat-halves"), -(-block // 2)
        # Equal items of a longer core are one, which stands at all their places.
        one = now.groupBy("_core", "_item", "_left", "_right").agg(F.least(F.sum("_many"), F.lit(2)).cast("int").alias("_many"))
        one = materialize(one, "repeat-half-items")
        sizes = materialize(one.groupBy("_core").agg(F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1"), "repeat-half-kinds")
        sized = one.join(sizes.hint("merge"), "_core", "left").filter("_kinds > 1 or _many > 1")
        own = extended(sized.filter(F.coalesce("_kinds", F.lit(1)) <= HOT).drop("_kinds"), block)
        back = now.select("_core0", "_item0", "_base", "_core", "_item").join(own.hint("merge"), ["_core", "_item"])
        spans = back.select("_core0", "_item0", (F.col("_base") + F.col("_first")).alias("_first"), (F.col("_base") + F.col("_last")).alias("_last"))
        found.append(materialize(spans, "repeat-half-spans"))
        large = sizes.filter(F.col("_kinds") > HOT)
        if large.isEmpty():
            break
        now = now.join(large.hint("merge"), "_core", "left_semi")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    # Windows of an item overlap as all hold its core: the first and the last one give the span.
    ends = every.groupBy("_core0", "_item0").agg(F.min("_first").cast("int").alias("_first"), F.max("_last").cast("int").alias("_last"))
    return ends.select(F.col("_core0").alias("_core"), F.col("_item0").alias("_item"), "_first", "_last")


def repeated_spans(rows: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(_key, _n, _spans): for each different text the spans of repeated windows as array<struct<a, b>>; rows: (_key, _text)."""
    wing, size = block - 1, length - block + 1
    kind = "_core long, _item long, _key long, _n int, _places array<int>"
    cores = materialize(arrow_map(rows, Cores(length, block), kind), "repeat-cores")
    # A place is told by its hash; equal texts are one, so a core of one place has one hash however often it was read.
    place = F.xxhash64("_key", "_n", F.col("_places")[0])
    spots = cores.groupBy("_core").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max(F.size("_places")).alias("c"))
    several = materialize(spots.filter("a <> b or c > 1").select("_core"), "repeat-several")
    # Written tables, so that a core of very many texts is a skewed join that AQE can split.
    wanted = materialize(cores.join(several.hint("merge"), "_core", "left_semi"), "repeat-wanted")
    wanted = materialize(wanted.distinct(), "repeat-places")
    # Items: different surroundings of a core, each with whether it stands at several places.
    first = F.struct("_key", "_n", F.col("_places")[0].alias("_place"))
    items = wanted.groupBy("_core", "_item").agg(F.sum(F.size("_places")).alias("_many"), F.min(first).alias("_at"))
    items = materialize(items, "repeat-items")
    kinds = materialize(items.groupBy("_core").agg(F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1"), "repeat-kinds")
    mixed = materialize(items.join(kinds.hint("merge"), "_core"), "repeat-mixed")
    places = mixed.groupBy(F.col("_at._key").alias("_k"), F.col("_at._n").alias("_kn")).agg(F.collect_set("_at._place").alias("_places"))
    places = materialize(places, "repeat-texts")
    near = flagged(rows, F.col("_key"), places, F.col("_k")).filter("_maybe")
    same = (F.col("_key") == F.col("_k")) & (F.octet_length("_text") == F.col("_kn"))
    texts = near.join(places.hint("merge"), same).select("_key", "_text", "_places")
    wings = arrow_map(texts, Wings(length, block), "_core long, _item long, _left binary, _right binary").dropDuplicates(["_core", "_item"])
    many = mixed.select("_core", "_item", F.least("_many", F.lit(2)).cast("int").alias("_many"), "_kinds")
    wings = materialize(wings.join(many.hint("merge"), ["_core", "_item"]), "repeat-wings")
    found = extended(wings.filter(F.col("_kinds") <= HOT).drop("_kinds"), block)
    hot = wings.filter(F.col("_kinds") > HOT)
    if not hot.isEmpty():
        found = found.union(cut_shards(hot, block))
    # All places of a core with one item have the same wings: all their windows repeat.
    alike = items.join(kinds.select("_core").hint("merge"), "_core", "left_anti")
    found = materialize(found.union(alike.select("_core", "_item", F.lit(0).alias("_first"), F.lit(wing).alias("_last"))), "repeat-found")
    # A window can't begin before the text or end behind it.
    begin = F.greatest(F.lit(0), F.col("_place") - wing + F.col("_first"))
    end = F.least(F.col("_n"), F.col("_place") - wing + F.col("_last") + length)
    spans = wanted.join(found.hint("merge"), ["_core", "_item"]).withColumn("_place", F.explode("_places"))
    spans = spans.select("_key", "_n", begin.alias("a"), end.alias("b"))
    return spans.groupBy("_key", "_n").agg(F.collect_set(F.struct("a", "b")).alias("_spans"))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Removed:
    """Replaces each text by what is left of it."""

    def __init__(self, length: int, keep_bytes: bool) -> None:
        self.length, self.keep_bytes = length, keep_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names = batch.schema.names
            rows: tuple[list, ...] = ([], [], [], [], [])
            for text, spans, copied in zip(texts_of(batch, "_text"), batch.column(names.index("_spans")).to_pylist(), batch.column(names.index("_copied")).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                if copied and len(raw) >= self.length:
                    gone = [(0, len(raw))]
                else:
                    gone = union_of([(s["a"], s["b"]) for s in spans or ()])
                left = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)]))
                for values, v in zip(rows, (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if self.keep_bytes else None)):
                    values.append(v)
            made = [pa.array(v, k) for v, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.record_batch([batch.column(names.index("_id")), *made], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per document: the id, n_bytes, n_removed, n_spans (long), kept_sha256 and kept (binary; null unless ``keep_bytes``).

    Every byte covered by a string of ``length`` bytes (at least 2 * block) that starts
    anywhere else too goes, in all its places.  Null texts are empty; texts of fewer
    bytes stay whole; rows that repeat are copies of each other whatever their id; a
    null id is kept; an empty table gives no rows.
    """
    if length < 2 * block:
        block = max(1, length // 2)
    if length < GRAM + block:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    spans = repeated_spans(rows.select("_key", "_text").filter(F.octet_length("_text") >= length), length, block)
    sizes = rows.filter(F.octet_length("_text") >= length).groupBy("_key", F.octet_length("_text").alias("_n")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_key", "_n", F.lit(True).alias("_copied"))
    known = materialize(spans.join(sizes, ["_key", "_n"], "full").select(F.col("_key").alias("_k"), F.col("_n").alias("_kn"), "_spans", "_copied"), "repeat-spans")
    split = flagged(rows, F.col("_key"), known, F.col("_k"))
    # Texts that can't have a span aren't shuffled.
    far = split.filter("not _maybe").select("_id", "_text", F.lit(None).cast(known.schema["_spans"].dataType).alias("_spans"), F.lit(False).alias("_copied"))
    near = split.filter("_maybe").join(known.hint("merge"), (F.col("_key") == F.col("_k")) & (F.octet_length("_text") == F.col("_kn")), "left").select("_id", "_text", "_spans", F.coalesce("_copied", F.lit(False)).alias("_copied"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = arrow_map(near.union(far), Removed(length, keep_bytes), f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("_id", id_col)
