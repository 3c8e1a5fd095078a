"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

The shingles of a text are put in one global order, rarest first: by the frequency of
the most frequent shingles of the corpus (a table of at most FREQUENT, counted over all
documents; a task with very many different shingles forgets those it has seen once so
far, so a count may be low, which costs candidates and never a link), then by hash.  Two sets that reach the threshold share a shingle in their
prefixes, so the prefixes are indexed.  Texts with equal sets are one class.  Classes
that share a prefix shingle meet in a cell; where the classes of a shingle all share
one hotter shingle, the hotter one's cell serves for both, so a set is sent about once.
Large cells are cut into tiles that meet in a ring, so a set is sent three times at most,
and what the ring connects meets no more; only the rest is compared with all tiles.  Index rows
go through the length and positional filters, then histograms of the sets through the
suffix filter.  What these filters connect is a part; the sets with a partner are sent
to their part, where pairs with a common prefix shingle are verified once.
A cell gives a spanning forest of its links, never all pairs of a group; where link
counts are asked for, sets meet all tiles of their part, every pair is verified and
each set's links are summed up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, flagged, materialize, packed, pieces, ranges, texts_of, unpacked
from .components import components
from .shingles import common, identity, sets

#: Most frequent shingles whose frequency the order knows.
FREQUENT = 1 << 17
#: Rows of one shingle that a task holds at once; of a shingle with more all rows pass.
HELD = 2_000_000
#: Texts with a shingle beyond which its index rows are spread over SALTS tasks, which then can't drop any.
HOT = 100_000
SALTS = 64
#: Classes of a tile.
TILE = 256
#: Shingles a task counts at once; beyond, those seen once are forgotten and counted anew.
COUNTED = 2_000_000
#: Bytes of the sets of a tile, about; a single larger set is a tile of its own.
TILE_BYTES = 8 << 20
#: Rows of a bin of cells with histograms, and bytes of one with sets, about.
BIN_ROWS = 1500
BIN_BYTES = 4 << 20


class Counter:
    """Shingles that a task sees twice or more, with how often: each text counts once."""

    def __init__(self, k: int) -> None:
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in pieces(batches):
            for own in sets(texts_of(batch, "_text"), self.k):
                waiting.append(own)
                size += len(own)
            if size > COUNTED // 2:
                seen, counts = self.merge(seen, counts, waiting)
                waiting, size = [], 0
                if len(seen) > COUNTED:
                    seen, counts = seen[counts > 1], counts[counts > 1]
        seen, counts = self.merge(seen, counts, waiting)
        yield pa.record_batch([pa.array(seen[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], names=["h", "n"])

    @staticmethod
    def merge(seen: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
        both, at = np.unique(np.concatenate([seen, new]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)


class Order:
    """The global order of shingles and the prefix lengths it allows."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, k: int, percent: int, hot: int = HOT) -> None:
        self.frequent, self.counts, self.k, self.percent, self.over = frequent, counts, k, percent, hot

    def ordered(self, own: np.ndarray) -> np.ndarray:
        """The set, rarest first."""
        if not len(self.frequent):
            return own
        at = np.searchsorted(self.frequent, own)
        at[at == len(self.frequent)] = 0
        return own[np.lexsort((own, np.where(self.frequent[at] == own, self.counts[at], 0)))]

    def hot(self, own: np.ndarray) -> list[int]:
        """Places of the shingles known to be in more texts than a task should get."""
        hot = self.frequent[self.counts > self.over]
        return np.flatnonzero(np.isin(own, hot)).tolist() if len(hot) else []

    def prefix(self, n: int) -> int:
        """Shingles of a set of n that a partner must meet: n less the least overlap, plus one."""
        return n - -(-self.percent * n // 100) + 1 if n else 0


class Prefixes:
    """(…, _cid, _n, _prefix, _hot, _hist) of each text."""

    def __init__(self, order: Order) -> None:
        self.order = order

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = sets(texts_of(batch, "_text"), self.order.k)
            ordered = [self.order.ordered(x)[: self.order.prefix(len(x))] for x in found]
            prefixes, hot = [x.view(np.int64) for x in ordered], [self.order.hot(x) for x in ordered]
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_text"]
            made = [pa.array([identity(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int32())), pa.array([histogram(x).tobytes() for x in found], pa.binary())]
            yield pa.record_batch([c for _, c in kept] + made, names=[n for n, _ in kept] + ["_cid", "_n", "_prefix", "_hot", "_hist"])


def histogram(own: np.ndarray) -> np.ndarray:
    """How many shingles begin with each value of their leading bits; about eight in each bin, 16 to 1024 bins."""
    bits = min(max(int(len(own)).bit_length() - 3, 4), 10)
    return np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)


def folded(h: np.ndarray, bins: int) -> np.ndarray:
    return h.reshape(bins, -1).sum(1)


def alike(hists: list[np.ndarray], tile: np.ndarray, cross: bool, percent: int) -> np.ndarray:
    """A number for each set of a cell: equal for sets that the length and suffix filters connect, -1 for sets without a partner.

    The suffix filter bounds the overlap by the sum of the smaller counts over all bins.
    """
    m = len(hists)
    n = np.array([int(h.sum()) for h in hists])
    size = np.array([len(h) for h in hists])
    up = np.arange(m)
    met = np.zeros(m, bool)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    # Sets that the length filter lets pair: twice as many bins at most from 50 per cent up, more below.
    wider = 1 << max(-(-100 // percent) - 1, 1).bit_length()
    for bins in np.unique(size):
        rows = np.flatnonzero((size >= bins) & (size <= wider * bins))
        table = np.stack([folded(hists[r], int(bins)) for r in rows]).astype(np.int32)
        for k, r in enumerate(rows[:-1].tolist()):
            rest = rows[k + 1 :]
            need = -(-percent * (n[r] + n[rest]) // (100 + percent))
            look = (np.minimum(size[r], size[rest]) == bins) & (np.minimum(n[r], n[rest]) * 100 >= percent * np.maximum(n[r], n[rest]))
            if cross:
                look &= tile[r] != tile[rest]
            at = np.flatnonzero(look)
            if not len(at):
                continue
            near = at[np.minimum(table[k], table[k + 1 + at]).sum(1) >= need[at]]
            for x in rest[near].tolist():
                met[[r, x]] = True
                up[root(r)] = root(x)
    return np.array([root(i) if met[i] else -1 for i in range(m)])


def _suffix_filter(percent: int):
    """Edges (a, b) that connect the classes of each cell that the filters connect."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((2, 0), np.int64)]
        for (_, i, j), own in pdf.groupby(["token", "i", "j"], sort=False):
            own = own.drop_duplicates("_cid")
            root = alike([np.frombuffer(b, np.uint32) for b in own["_hist"]], own["tile"].to_numpy(), i != j, percent)
            ids, rows = own["_cid"].to_numpy(np.int64), np.flatnonzero(root >= 0)
            rows = rows[root[rows] != rows]
            out.append(np.stack([ids[rows], ids[root[rows]]]))
        a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return keep


class Viable:
    """Of rows (token, cid, n, place, salt) sorted by token those with a partner that passes the length and positional filters; rows with a salt all pass.

    With P for the percentage, i and j pass if n_j P <= (n_i - place_i)(100 + P) - n_i P
    and n_i P <= (n_j - place_j)(100 + P) - n_j P, which also bounds the lengths.  So
    in the order of n a running maximum tells whether there is such a j: no pairs are made.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_token", "_cid", "_n", "_place"]
        held: list[pa.RecordBatch] = []
        passing = None  # a token of which some rows have passed without a look at the others
        for batch in batches:
            free = batch.column(4).to_numpy() >= 0
            if passing is not None:
                free |= batch.column(0).to_numpy() == passing
            if free.any():
                through = batch.filter(pa.array(free))
                yield pa.record_batch([through.column(i) for i in range(4)], names=names)
                batch = batch.filter(pa.array(~free))
            if not batch.num_rows:
                continue
            held.append(batch)
            first, last = held[0].column(0)[0].as_py(), batch.column(0)[batch.num_rows - 1].as_py()
            rows = sum(b.num_rows for b in held)
            if first == last:
                if rows > HELD:
                    passing = last
                    for b in held:
                        yield pa.record_batch([b.column(i) for i in range(4)], names=names)
                    held = []
                continue
            if rows < 50_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(table.column(0).to_numpy() != last)[-1]) + 1
            yield self.kept(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield self.kept(pa.Table.from_batches(held))

    def kept(self, table: pa.Table) -> pa.RecordBatch:
        token, cid, n, place = (table.column(i).to_numpy() for i in range(4))
        order = np.lexsort((n, token))
        keep = order[self.viable(token[order], n[order].astype(np.int64), place[order].astype(np.int64))]
        return pa.record_batch([pa.array(x[keep]) for x in (token, cid, n, place)], names=["_token", "_cid", "_n", "_place"])

    def viable(self, token: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(token):
            return np.zeros(0, bool)
        p = self.percent
        group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]).astype(np.int64)]))
        reach = (n - place) * (100 + p) - p * n
        span = int(max(n.max() * 200, 1)) + 1
        # Running largest and second largest reach within a token; a row itself is one of them if it passes with itself.
        lifted = group * span + np.maximum(reach, 0)
        most = np.maximum.accumulate(lifted)
        second = np.maximum.accumulate(np.concatenate([[group[0] * span], np.maximum(np.minimum(lifted[1:], most[:-1]), group[1:] * span)]))
        limit = group * span + np.clip(reach // p, 0, span - 1)
        upto = np.searchsorted(group * span + n, limit, "right") - 1
        ok = (upto >= 0) & (group[np.maximum(upto, 0)] == group) & (reach > 0)
        upto = np.maximum(upto, 0)
        own = (upto >= np.arange(len(n))) & (reach >= p * n)
        best = np.where(own, second[upto], most[upto]) - group * span
        return ok & (best >= p * n) & (best > 0)


class Sets:
    """One row for each cell of a class: its whole set, rarest first, as bytes."""

    def __init__(self, order: Order) -> None:
        self.order = order

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("bin", pa.int32()), ("part", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("tile", pa.int32()), ("cid", pa.int64()), ("copies", pa.int64()), ("set", pa.binary())])
        for batch in pieces(batches, 200):
            cells, wanted, copies = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_cells", "_cid", "_copies"))
            rows: list[dict] = []
            size = 0
            for own, cid, places, n in zip(sets(texts_of(batch, "_text"), self.order.k), wanted, cells, copies):
                if identity(own) != cid:
                    continue
                data = self.order.ordered(own).tobytes()
                for c in places:
                    rows.append(c | {"cid": cid, "copies": n, "set": data})
                    size += len(data)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, kind)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """The least Hamming distance that two sorted sets can have, by halving at pivots."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    a, b = np.searchsorted(x, pivot), len(y) // 2
    return suffix_bound(x[:a], y[:b], depth - 1) + suffix_bound(x[a:], y[b:], depth - 1)


def candidates(own: list[np.ndarray], prefix: list[int], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) that share a prefix shingle and pass the length and positional filters; own: sets, rarest first."""
    n = np.array([len(x) for x in own])
    doc = np.repeat(np.arange(len(own)), prefix)
    token = np.concatenate([x[:p] for x, p in zip(own, prefix)]) if own else np.zeros(0, np.uint64)
    place = ranges(np.zeros(len(own), np.int64), np.array(prefix))
    order = np.lexsort((doc, token))
    doc, token, place = doc[order], token[order], place[order]
    end = np.searchsorted(token, token, "right")
    later = end - np.arange(len(token)) - 1
    a = np.repeat(np.arange(len(token)), later)
    b = ranges(np.arange(len(token)) + 1, later)
    # Nothing before the first shared shingle is shared, so what follows it bounds the overlap; a pair that fails at its first one may pass at no later one.
    i, j = doc[a], doc[b]
    need = -(-percent * (n[i] + n[j]) // (100 + percent))
    size = np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])
    bound = np.minimum(n[i] - place[a], n[j] - place[b])
    keep = size & (bound >= need)
    pair = np.unique(i[keep] * len(own) + j[keep])
    return pair // max(len(own), 1), pair % max(len(own), 1)


def linked(own: list[np.ndarray], prefix: list[int], tile: np.ndarray, cross: bool, percent: int, copies: np.ndarray | None = None, sums: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links in a cell, as pairs of indices; cross: only between different tiles.

    With ``sums`` all links are found, and the copies that each set is linked with are added to it.
    """
    i, j = candidates(own, prefix, percent)
    if cross:
        other = tile[i] != tile[j]
        i, j = i[other], j[other]
    if not len(i):
        return []
    up = list(range(len(own)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    flat = [np.sort(x) for x in own]
    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = root(a), root(b)
        if ra == rb and sums is None:
            continue
        total = len(flat[a]) + len(flat[b])
        need = -(-percent * total // (100 + percent))
        if suffix_bound(flat[a], flat[b]) > total - 2 * need:
            continue
        shared = common(flat[a], flat[b])
        if 100 * shared >= percent * (total - shared):
            if sums is not None:
                sums[a] += copies[b]
                sums[b] += copies[a]
            if ra != rb:
                up[ra] = rb
                out.append((a, b))
    return out


def _cells(order: Order, count: bool):
    """Links (a, b, null) of a spanning forest and, with ``count``, (a, null, n): copies that class a is linked with in a cell."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int | None, int | None]] = []
        for (_, i, j), own in pdf.groupby(["part", "i", "j"], sort=False):
            own = own.drop_duplicates("cid")
            if len(own) < 2:
                continue
            values = [np.frombuffer(b, np.uint64) for b in own["set"]]
            ids = own["cid"].to_numpy()
            sums = np.zeros(len(own), np.int64) if count else None
            found += [(ids[a], ids[b], None) for a, b in linked(values, [order.prefix(len(v)) for v in values], own["tile"].to_numpy(), i != j, order.percent, own["copies"].to_numpy(), sums)]
            if count:
                found += [(ids[a], None, sums[a]) for a in np.flatnonzero(sums)]
        return pd.DataFrame({name: pd.array([row[c] for row in found], dtype="Int64") for c, name in enumerate(("a", "b", "n"))})

    return join


def frequent_shingles(rows: DataFrame, k: int, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` of the most frequent shingles over all texts, sorted by hash, with their counts.

    A histogram of the counts, in steps of a sixteenth of a doubling, tells from which
    step on the shingles are few enough, so only these come to the driver.
    """
    level = F.floor(16 * F.log2("n")).cast("int")
    counted = arrow_map(rows.select("_text"), Counter(k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = materialize(counted.filter("n > 3"), "jaccard-frequent")
    steps = counted.groupBy(level.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    from_step, total = 1 << 20, 0
    for step, n in sorted(((r.step, r.n) for r in steps), reverse=True):
        total += n
        if total > size:
            break
        from_step = step
    got = counted.filter(level >= from_step).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy(np.int64)[order]


def tiles_of(rows: str, size: str, tile: int) -> Column:
    """Tiles for so many classes, whose sets have so many bytes."""
    return F.expr(f"cast(greatest(({rows} + {tile - 1}) div {tile}, ({size} + {TILE_BYTES - 1}) div {TILE_BYTES}) as int)")


def paired(rows: DataFrame, others: str = "sequence(0, _tiles - 1)") -> DataFrame:
    """``rows`` once for each pair of tiles (i <= j) that their ``tile`` makes with ``others``."""
    sent = rows.withColumn("_other", F.explode(F.expr(others)))
    ends = {"i": F.least("_tile", "_other"), "j": F.greatest("_tile", "_other"), "tile": F.col("_tile")}
    return sent.withColumns(ends).drop("_tiles", "_tile", "_other")


def strangers(rows: DataFrame, group: str, parts: DataFrame, tile: int) -> DataFrame:
    """What rings have left open: ``rows`` of groups that ``parts`` don't connect, once for each pair of tiles to compare.

    The classes of a group's largest component need no comparison with each other.  The
    others are dealt to tiles of their own, behind those of the largest component, and
    these meet all tiles of the group.
    """
    joined = rows.join(parts.select(F.col("node").alias("_cid"), "component"), "_cid", "left")
    named = joined.withColumn("_own", F.coalesce("component", "_cid")).drop("component", "_tiles", "_tile")
    sizes = named.groupBy(group, "_own").agg(F.count(F.lit(1)).alias("g"), (8 * F.sum("_n")).alias("size"))
    largest = sizes.groupBy(group).agg(F.max(F.struct("g", "_own", "size")).alias("_m"), F.sum("g").alias("_g"), F.sum("size").alias("_s"))
    open_ = largest.withColumns({"_g": F.col("_g") - F.col("_m.g"), "_s": F.col("_s") - F.col("_m.size")}).filter("_g > 0")
    tiles = {"_first": tiles_of("_m.g", "_m.size", tile), "_more": tiles_of("_g", "_s", tile), "_main": F.col("_m._own")}
    open_ = materialize(open_.withColumns(tiles).select(F.col(group).alias("_of"), "_main", "_first", "_more"), "jaccard-open")
    left = named.join(broadcast_if_small(open_), F.col(group) == F.col("_of"))
    own = F.when(F.col("_own") == F.col("_main"), F.pmod(F.xxhash64("_cid"), F.col("_first")))
    left = left.withColumn("_tile", own.otherwise(F.col("_first") + F.pmod(F.xxhash64("_cid"), F.col("_more"))).cast("int"))
    met = "sequence(if(_tile < _first, _first, 0), _first + _more - 1)"
    return paired(left.withColumn("_tiles", F.col("_first") + F.col("_more")), met).drop("_own", "_of", "_main", "_first", "_more")


def in_rings(rows: DataFrame, group: str, compare: Callable[[DataFrame], DataFrame], tile: int) -> DataFrame:
    """Edges (a, b) of ``compare`` whose components are those of all pairs of a group; rows: (``group``, _cid, _n, _tiles, _tile).

    Tiles meet themselves and the next tile in a ring, so a set is sent three times at
    most, which connects a group of near copies.  Only what stays apart in groups of
    more than three tiles (a ring of three holds all pairs) is compared with the rest.
    """
    ring = "array_distinct(array(_tile, (_tile + 1) % _tiles, (_tile + _tiles - 1) % _tiles))"
    edges = compare(paired(rows, ring))
    wide = rows.filter("_tiles > 3")
    if wide.isEmpty():
        return edges
    left = materialize(strangers(wide, group, components(edges.select("a", "b")), tile), "jaccard-strangers")
    return edges if left.isEmpty() else edges.unionByName(compare(left))


def join_classes(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, count: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, counts): (_id, _th, _cid, _n) of every row, and links (a, b) between classes whose components are those of all links.

    counts: (_c3, _partners), rows of other classes that the rows of class _c3 are
    linked with; empty without ``count``, as it needs every pair of a group verified.
    _th: xxhash64 of the text; _cid: hash of the set, 0 for the empty one.
    """
    if not 0 < percent <= 100 or k < 1:
        raise ValueError("percent must be 1 to 100 and k at least 1")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    order = Order(*frequent_shingles(rows, k), k, percent, HOT)
    scanned = materialize(arrow_map(rows, Prefixes(order), f"_id {kind}, _th long, _cid long, _n long, _prefix array<long>, _hot array<int>, _hist binary"), "jaccard-prefixes")
    classes = scanned.filter("_n > 0").groupBy("_cid").agg(F.min(F.struct("_id", "_th")).alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.first("_n").alias("_n"), F.first("_prefix").alias("_prefix"), F.first("_hot").alias("_hot"), F.first("_hist").alias("_hist"))
    salt = F.when(F.array_contains("_hot", F.col("_place")), F.pmod("_cid", F.lit(SALTS)).cast("int")).otherwise(-1)
    index = classes.select("_cid", "_n", "_hot", F.posexplode("_prefix").alias("_place", "_token")).select("_token", "_cid", F.col("_n").cast("int"), "_place", salt.alias("_salt"))
    viable = arrow_map(index.repartition("_token", "_salt").sortWithinPartitions("_token"), Viable(percent), "_token long, _cid long, _n int, _place int")
    viable = materialize(viable, "jaccard-viable")
    met = materialize(viable.groupBy("_token").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1"), "jaccard-tokens")
    shared = materialize(viable.join(met.hint("merge"), "_token"), "jaccard-index")
    home = shared.groupBy("_cid").agg(F.max(F.struct("_df", "_token")).alias("_home")).select("_cid", F.col("_home._token").alias("_home"))
    homed = shared.join(home, "_cid")
    served = homed.groupBy("_token").agg(F.min("_home").alias("_h1"), F.max("_home").alias("_h2")).filter("_h1 = _h2 and _h1 <> _token").select("_token")
    cells = shared.join(served, "_token", "left_anti").withColumn("_tiles", F.expr(f"cast((_df + {tile - 1}) div {tile} as int)"))
    cells = cells.withColumn("_tile", F.pmod(F.xxhash64("_cid"), F.col("_tiles")).cast("int"))
    cells = materialize(cells.select("_cid", F.col("_token").alias("token"), F.lit(0).alias("_n"), "_tiles", "_tile"), "jaccard-cells")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # First only histograms of the sets: what the suffix filter connects forms parts, and a set is sent to its part.
    def filtered(sent: DataFrame) -> DataFrame:
        bins = max(least, sent.count() // BIN_ROWS)
        sketched = sent.join(classes.select("_cid", "_hist"), "_cid")
        sketched = sketched.withColumn("bin", F.pmod(F.xxhash64("token", "i", "j"), F.lit(bins)).cast("int"))
        edges = sketched.groupBy("bin").applyInPandas(_suffix_filter(percent), "a long, b long")
        return materialize(edges, "jaccard-edges")

    parts = components(in_rings(cells, "token", filtered, tile)).select(F.col("node").alias("_cid"), F.col("component").alias("part"))
    sized = parts.join(classes.select("_cid", "_n"), "_cid")
    sizes = sized.groupBy("part").agg(F.count(F.lit(1)).alias("_g"), (8 * F.sum("_n")).alias("_bytes"))
    tiled = sized.join(sizes, "part").withColumn("_tiles", tiles_of("_g", "_bytes", tile))
    tiled = tiled.withColumn("_tile", F.pmod(F.xxhash64("_cid"), F.col("_tiles")).cast("int")).drop("_g", "_bytes")
    tiled = materialize(tiled, "jaccard-parts")
    reps = classes.select("_cid", "_copies", F.col("_rep._id").alias("_rid"), F.col("_rep._th").alias("_rth"))

    def verified(sent: DataFrame) -> DataFrame:
        bins = max(least, (sent.agg(F.sum(8 * F.col("_n"))).first()[0] or 0) // BIN_BYTES)
        cell = F.struct(F.pmod(F.xxhash64("part", "i", "j"), F.lit(bins)).cast("int").alias("bin"), "part", "i", "j", "tile")
        placed = sent.select("_cid", cell.alias("c")).groupBy("_cid").agg(F.collect_list("c").alias("_cells"))
        placed = materialize(placed.join(reps, "_cid"), "jaccard-places")
        near = flagged(rows, F.col("_th"), placed, F.col("_rth")).filter("_maybe")
        same = (F.col("_th") == F.col("_rth")) & F.col("_id").eqNullSafe(F.col("_rid"))
        texts = near.join(placed.hint("merge"), same).select("_text", "_cid", "_copies", "_cells")
        whole = arrow_map(texts, Sets(order), "bin int, part long, i int, j int, tile int, cid long, copies long, set binary")
        return materialize(whole.groupBy("bin").applyInPandas(_cells(order, count), "a long, b long, n long"), "jaccard-links")

    found = verified(paired(tiled)) if count else in_rings(tiled, "part", verified, tile)
    counts = found.filter("n is not null").groupBy(F.col("a").alias("_c3")).agg(F.sum("n").alias("_partners"))
    return scanned.drop("_prefix", "_hot", "_hist"), found.filter("b is not null").select("a", "b"), counts


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", count: bool = False) -> DataFrame:
    """One row per document: the id, n_shingles (long) and component_id; with ``count`` n_links (long), too.

    Words are runs without white space, A-Z lower-cased; a set holds the ``k``-word
    shingles, or all words as one if they are fewer; documents link when the Jaccard
    similarity is at least ``percent`` / 100.  component_id is the smallest id reachable
    by links.  Null texts and texts without words have empty sets, which link with
    nothing: their component is their own id.  Rows that repeat each get a row; a null
    id takes part in links and is never the smallest; an empty table gives no rows.
    n_links: the other rows that the row is linked with, equal sets among them; then
    every pair of a group is verified, not only those of a spanning forest.
    """
    members, links, counts = join_classes(docs, k=k, percent=percent, id_col=id_col, text_col=text_col, count=count)
    least = members.filter("_n > 0").groupBy("_cid").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"))
    parts = components(links)
    lowest = parts.join(least, parts["node"] == least["_cid"]).groupBy("component").agg(F.min("_least").alias("_lowest"))
    judged = least.join(parts.join(lowest, "component").select(F.col("node").alias("_cid"), "_lowest"), "_cid", "left").select(F.col("_cid").alias("_c2"), F.coalesce("_lowest", "_least").alias("_component"), "_copies")
    if count:
        judged = judged.join(counts, F.col("_c2") == F.col("_c3"), "left").select("_c2", "_component", (F.col("_copies") - 1 + F.coalesce("_partners", F.lit(0))).alias("_links"))
    # A written table, so that a class of very many copies is a skewed join that AQE can split.
    judged = materialize(judged, "jaccard-components").hint("merge")
    n_links = [F.coalesce("_links", F.lit(0)).cast("long").alias("n_links")] if count else []
    return members.join(judged, (F.col("_n") > 0) & (F.col("_cid") == F.col("_c2")), "left").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_component", F.when(F.col("_n") == 0, F.col("_id"))).alias("component_id"), *n_links)


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest id; same columns.

    Documents without words are no duplicates and stay.  Of rows that repeat wholly in
    id and text one stays.
    """
    members, links, _ = join_classes(docs, k=k, percent=percent)
    parts = components(links)
    classes = members.filter("_n > 0").groupBy("_cid").agg(F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_th")).alias("_rep"))
    grouped = classes.join(parts, F.col("_cid") == F.col("node"), "left").select("_cid", "_rep", F.coalesce("component", "_cid").alias("_group"))
    best = grouped.groupBy("_group").agg(F.min("_rep").alias("_best"))
    # The documents that go are the fewer; those that repeat wholly are dealt with apart.
    chosen = grouped.join(best, "_group").select(F.col("_cid").alias("_c2"), "_best")
    each = members.filter("_n > 0").groupBy("_id", "_th", "_cid").agg(F.count(F.lit(1)).alias("_copies"))
    judged = materialize(each.join(chosen, F.col("_cid") == F.col("_c2")).select("_id", "_th", "_copies", (F.col("_id").eqNullSafe(F.col("_best._id")) & (F.col("_th") == F.col("_best._th"))).alias("_stays")), "jaccard-judged")
    gone = judged.filter("not _stays").select(F.col("_id").alias("_gone"), F.col("_th").alias("_gone_th"))
    twice = judged.filter("_stays and _copies > 1").select(F.col("_id").alias("_gone"), F.col("_th").alias("_gone_th"))
    hashed = packed(docs, _id=F.col("doc_id"), _th=F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_th") == F.col("_gone_th"))
    # Only texts that may be among those that go are shuffled for the join.
    split = flagged(hashed, F.col("_th"), gone.union(twice), F.col("_gone_th"))
    near = split.filter("_maybe").drop("_maybe")
    rest = near.join(gone.hint("merge"), same, "left_anti")
    if not twice.isEmpty():
        once = rest.join(twice.hint("merge"), same, "left_semi").dropDuplicates(["_id", "_th"])
        rest = rest.join(twice.hint("merge"), same, "left_anti").unionByName(once)
    return unpacked(split.filter("not _maybe").drop("_maybe").unionByName(rest))
