"""Lists of tickets for Arrow batches of rows: the tickets of the expressions in ``sampling`` and ``arrays``, by the column.

A backtest with a split for each draw hashes every number of every ticket of every
split.  Here a batch is hashed at once, a tenth of the work of the expressions; a list
is a function of its row alone, so batches and partitions don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that are hashed at a time, so that they stay in a core's cache.
AT_ONCE = 1 << 15
#: Rows that share a table of their numbers.
ROWS = 256
#: Stands for a null among numbers of 32 bits; sorted last.
NULL = 1 << 40
TICKETS = "array<array<int>>"
CANDIDATES = "array<struct<number:int,weight:double>>"

# MD5 (RFC 1321) up to the step after which the first word of the digest is known.
_STEPS = 61
_SINES = (np.abs(np.sin(np.arange(1, _STEPS + 1, dtype=np.float64))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _blocks(texts: list[bytes], begin: int, end: bool) -> np.ndarray:
    """(texts, 16): the words of MD5's block that the texts fill from the byte ``begin`` on; with what ends a message behind them."""
    out = np.zeros((len(texts), 64), np.uint8)
    for row, text in zip(out, texts):
        row[begin : begin + len(text)] = np.frombuffer(text, np.uint8)
        if end:
            row[begin + len(text)] = 0x80
            row[56:58] = divmod((begin + len(text)) * 8, 256)[::-1]
    return out.view("<u4")


def _first_words(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """(heads, tails): the first word of the MD5 of each head with each tail behind it; a message is one block."""
    words = []
    for i in range(16):
        head, tail = heads[:, i : i + 1], tails[None, :, i]
        # Most words depend on the head or on the tail alone, and are added as a column or a row.
        words.append((head | tail if head.any() else tail) if tail.any() else head)
    # Steps over words of the head alone are made once a head.
    alone = next(i for i in range(16) if tails[:, i].any())
    shape = len(heads), 1
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(_STEPS):
        if i == alone:
            shape = len(heads), len(tails)
            a, b, c, d, f, turned = (np.broadcast_to(x, shape).copy() for x in (a, b, c, d, f, turned))
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_WORDS[i]] + _SINES[i]
        np.right_shift(f, 32 - _TURNS[i], out=turned)
        f <<= _TURNS[i]
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b


def uniforms(stream: str, seeds: np.ndarray, count: int, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, (rows, count, numbers) of ``sampling.uniform``), some rows at a time, all of ``seeds`` once."""
    tails = [f"|{t}|{n}".encode() for t in range(count) for n in numbers.tolist()]
    heads = [f"{stream}|{s}".encode() for s in seeds.tolist()]
    lengths = np.array([len(h) for h in heads], np.int64)
    step = max(1, AT_ONCE // max(len(tails), 1))
    for length in np.unique(lengths):
        rows, after = np.flatnonzero(lengths == length), _blocks(tails, int(length), True)
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            word = _first_words(_blocks([heads[i] for i in some], 0, False), after).byteswap()
            yield some, ((word.astype(np.float64) + 1) / 4294967297.0).reshape(len(some), count, len(numbers))


def smallest(key: np.ndarray, u: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
    """Where the ``size`` smallest of the last axis are, by (key, u, place), of those that are ``there``; all if there are fewer."""
    if not there.all():
        key = np.where(there, key, np.inf)
    if key.shape[-1] <= size:
        return np.broadcast_to(there, key.shape).copy()
    last = np.partition(key, size - 1, axis=-1)[..., size - 1 : size]
    out = key <= last
    # Keys that tie at the end, or are infinite there, go by all three.
    odd = (out.sum(-1) != size) | ~np.isfinite(last[..., 0])
    if odd.any():
        absent = ~np.broadcast_to(there, key.shape)[odd]
        first = np.lexsort((u[odd], key[odd], absent), axis=-1)[..., :size]
        won = np.zeros(absent.shape, bool)
        np.put_along_axis(won, first, True, axis=-1)
        out[odd] = won & ~absent
    return out


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())


def _nested(tickets: np.ndarray, sizes: np.ndarray, numbers: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """The lists with so many ``tickets`` each, of ``sizes`` numbers each."""
    inner = pa.ListArray.from_arrays(_offsets(sizes), numbers)
    return pa.ListArray.from_arrays(_offsets(tickets), inner, mask=None if null is None else pa.array(null))


def _drawn(stream: str, seeds: np.ndarray, count: np.ndarray, numbers: np.ndarray, weights: np.ndarray | None, there: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of each ticket, all their numbers) of rows with ``count`` tickets each out of ascending ``numbers``; no weights: by u."""
    most = int(count.max(initial=0))
    won = np.zeros((len(seeds), most, len(numbers)), bool)
    for rows, u in uniforms(stream, seeds, most, numbers):
        key = u
        if weights is not None:
            w = weights[rows][:, None, :]
            key = -np.log(u)
            key = key / w if (w > 0).all() else np.divide(key, w, out=np.full(u.shape, np.inf), where=w > 0)
        won[rows] = smallest(key, u, there[rows][:, None, :], size)
    won = won[np.arange(most) < count[:, None]]
    return won.sum(-1), numbers[np.nonzero(won)[1]]


def weighted_list(seeds: np.ndarray, candidates: pa.Array, count: int, size: int, stream: str = "engine") -> pa.Array:
    """``count`` tickets for each row, of the row's candidates (number, weight), which are different."""
    sizes, drawn = [], []
    for low in range(0, len(seeds), ROWS):
        part = candidates.slice(low, ROWS)
        lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = part.flatten()
        number, weight = flat.field("number").to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False)
        numbers, place = np.unique(number, return_inverse=True)
        row = np.repeat(np.arange(len(part)), lengths)
        weights, there = np.zeros((len(part), len(numbers))), np.zeros((len(part), len(numbers)), bool)
        weights[row, place], there[row, place] = weight, True
        a, b = _drawn(stream, seeds[low : low + ROWS], np.full(len(part), count), numbers, weights, there, size)
        sizes.append(a)
        drawn.append(b)
    return _nested(np.full(len(seeds), count), np.concatenate(sizes), pa.array(np.concatenate(drawn), pa.int32()))


def uniform_list(seeds: np.ndarray, counts: np.ndarray, size: int, low: int, high: int, stream: str = "baseline") -> pa.Array:
    """So many tickets for each row as ``counts`` says, of the numbers low..high, all equally likely."""
    numbers, sizes, drawn = np.arange(low, high + 1), [], []
    for at in range(0, len(seeds), ROWS):
        there = np.ones((len(seeds[at : at + ROWS]), len(numbers)), bool)
        a, b = _drawn(stream, seeds[at : at + ROWS], counts[at : at + ROWS], numbers, None, there, size)
        sizes.append(a)
        drawn.append(b)
    return _nested(counts, np.concatenate(sizes), pa.array(np.concatenate(drawn), pa.int32()))


def diverse_list(lists: pa.Array, max_overlap: int, max_tickets: int) -> pa.Array:
    """The choice of ``arrays.greedy_diverse`` from each row's tickets; a null list stays null."""
    null = lists.is_null().to_numpy(zero_copy_only=False)
    tickets = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = lists.flatten()
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False)
    values = inner.flatten().cast(pa.int64()).fill_null(NULL).to_numpy()
    ends = np.concatenate(([0], np.cumsum(tickets)))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    chosen, drawn, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(lists), ROWS):
        n = tickets[low : low + ROWS]
        first, last = ends[low], ends[low + len(n)]
        length = sizes[first:last]
        # (tickets, numbers), ascending; what is not there is above all numbers.
        flat = np.full((last - first, int(length.max(initial=0))), 2 * NULL)
        flat[np.arange(flat.shape[1]) < length[:, None]] = values[starts[first] : starts[last]]
        flat.sort(axis=-1)
        which = _greedy(n, flat, max_overlap, max_tickets)
        won = flat[which]
        here = won < 2 * NULL
        chosen.append(np.bincount(np.repeat(np.arange(len(n)), n)[which], minlength=len(n)))
        drawn.append(here.sum(-1))
        kept.append(won[here])
    out = np.concatenate(kept)
    return _nested(np.concatenate(chosen), np.concatenate(drawn), pa.array(np.where(out == NULL, 0, out), pa.int32(), mask=out == NULL), null)


def _greedy(n: np.ndarray, flat: np.ndarray, max_overlap: int, max_tickets: int) -> np.ndarray:
    """Which of the tickets ``flat``, ascending rows, are chosen; ``n`` of them in each list.

    A ticket is a set of bits, a word for 64 of the different numbers.
    """
    numbers, place = np.unique(flat, return_inverse=True)
    place = place.reshape(flat.shape)
    there = flat < 2 * NULL
    bits = np.zeros((len(flat), len(numbers) // 64 + 1), np.uint64)
    for j in range(flat.shape[1]):
        bit = np.where(there[:, j], np.uint64(1) << (place[:, j] % 64).astype(np.uint64), np.uint64(0))
        bits[np.arange(len(flat)), place[:, j] // 64] |= bit
    most = int(n.max(initial=0))
    listed = np.arange(most) < n[:, None]
    full = np.zeros((len(n), most, bits.shape[1]), np.uint64)
    full[listed] = bits
    # Tickets are equal as sets where no number repeats, else by all their numbers.
    same = full
    if (there[:, 1:] & (flat[:, 1:] == flat[:, :-1])).any():
        same = np.zeros((len(n), most, 1), np.uint64)
        same[listed, 0] = np.unique(flat, axis=0, return_inverse=True)[1].reshape(-1)
    room = min(max_tickets, most)
    taken, known = np.zeros((len(n), room, full.shape[2]), np.uint64), np.zeros((len(n), room, same.shape[2]), np.uint64)
    held, out = np.zeros(len(n), np.int64), np.zeros((len(n), most), bool)
    for t in range(most):
        deep = int(held.max(initial=0))
        shared = np.bitwise_count(taken[:, :deep] & full[:, t, None]).sum(-1, dtype=np.int64)
        refused = ((shared > max_overlap) | (known[:, :deep] == same[:, t, None]).all(-1)) & (np.arange(deep) < held[:, None])
        won = np.flatnonzero(listed[:, t] & (held < room) & ~refused.any(-1))
        taken[won, held[won]], known[won, held[won]] = full[won, t], same[won, t]
        out[won, t] = True
        held[won] += 1
    return out[listed]


def _function(f: Callable[..., pa.Array]) -> Callable[..., Column]:
    return F.arrow_udf(f, TICKETS)


def _longs(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def weighed(seen: Column, frequency_weight: float, recency_weight: float) -> Column:
    """The array of (number, weight) of an array of (number, count): the scores of ``NumberPredictor`` without recency."""

    def made(lists: pa.Array) -> pa.Array:
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        counts = flat.field("count").to_numpy(zero_copy_only=False).astype(np.float64)
        row, most = np.repeat(np.arange(len(lists)), lengths), np.ones(len(lists))
        np.maximum.at(most, row, counts)
        weights = (frequency_weight * (counts / most[row]) + recency_weight * 0.0) / (frequency_weight + recency_weight)
        pairs = pa.StructArray.from_arrays([flat.field("number"), pa.array(weights)], ["number", "weight"])
        return pa.ListArray.from_arrays(_offsets(lengths), pairs)

    return F.arrow_udf(made, CANDIDATES)(seen)


def weighted_tickets(candidates: Column, seed: Column, count: int, size: int) -> Column:
    """An array of ``count`` tickets as ``sampling.weighted_ticket`` makes them, numbered from 0."""

    def made(c: pa.Array, s: pa.Array) -> pa.Array:
        return weighted_list(_longs(s), c, count, size)

    return _function(made)(candidates, seed.cast("long"))


def uniform_tickets(seed: Column, count: Column, size: int, low: int, high: int) -> Column:
    """An array of ``count`` tickets as ``sampling.uniform_ticket`` makes them; empty for 0 or less."""

    def made(s: pa.Array, n: pa.Array) -> pa.Array:
        return uniform_list(_longs(s), np.maximum(_longs(n), 0), size, low, high)

    return _function(made)(seed.cast("long"), F.coalesce(count, F.lit(0)))


def diverse_tickets(tickets: Column, max_overlap: int, max_tickets: int) -> Column:
    """The choice of ``arrays.greedy_diverse``."""

    def made(t: pa.Array) -> pa.Array:
        return diverse_list(t, max_overlap, max_tickets)

    return _function(made)(tickets.cast(TICKETS))
