"""Mixture-controlled packing of documents into windows of equal length.

Each source's documents form a queue of tokens.  Deficit round-robin over the queues
fills the windows: every window credits a queue with its share of the window's tokens, the
queue gives the whole tokens of its credit, the tokens that are then missing come from the
largest remainders, and what a queue has over or under is its deficit, carried to the next window.
Because queues may be cut at any token, the deficits after any number of windows follow from
the shares alone (``Apportionment``), so each task works out the windows of its own
documents, and the deficits carry across partitions without a pass over the windows
before.  When a queue runs out, the others go on with their shares of what is left (``Phase``).
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, materialize, ranges

#: Default vocabulary: a tokenizers file; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Tokens of a sequence.
WINDOW = 2048
#: Sources with less than this share of the tokens have a queue together.
LEAST_SHARE = 1 / 128
#: The sum of all integer weights is at most this, so that sums within a frame fit into 64 bits.
MOST_WEIGHT = 1 << 45
#: Windows of a frame, whose begin is worked out in big integers.
FRAME = 64


# Fixed value: the pre-tokenising pattern of byte-level BPE files that name none.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The function that encodes a text, without special tokens added, to uint32 ids; loaded once in each worker.

    Where the file is plain byte-level BPE whose merges stand in the order of their ids,
    tiktoken gives the same ids at a quarter of the CPU time (checked by the tests);
    any other file is left to the tokenizers library.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab") if model.get("type") == "BPE" else None
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = vocabulary and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = plain and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if plain:
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [vocabulary[m] for m in joined]
        plain = ids == sorted(set(ids)) and len(ids) + 256 == len(vocabulary.keys() - added.keys())
    if plain:
        import tiktoken

        table = byte_characters()
        ranks = {bytes(table[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        encoding = tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


class Encode:
    """(id, _source, _task, _before, _n, _ids): a document's ids with the end id, and its source's tokens before it in this task."""

    def __init__(self, path: str, end: int) -> None:
        self.path, self.end = path, end

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(self.path), TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for batch in batches:
            sources, before, n, packed = batch.column(1).to_pylist(), [], [], []
            for source, text in zip(sources, batch.column(2)):
                found = encode(text.as_py() or "")
                ids = np.append(found, np.array([self.end], found.dtype))
                before.append(seen.get(source, 0))
                n.append(len(ids))
                seen[source] = before[-1] + len(ids)
                packed.append((b"\2" + ids.astype("<u2").tobytes()) if ids.max() < 1 << 16 else (b"\4" + ids.astype("<u4").tobytes()))
            tasks = pa.array(np.full(batch.num_rows, task, np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), tasks, pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["_id", "_source", "_task", "_before", "_n", "_ids"])


def ids_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4")


@dataclass
class Apportionment:
    """What queues of integer weights have given after any number of windows, by largest remainders.

    After j windows a queue has given the whole part of j * window * weight / sum, and one
    token more if its remainder is among the largest (ties: the first queue), as many as
    are missing.  So it is less than one token off its share at every window.
    """

    weights: list[int]
    window: int

    def at(self, j: np.ndarray) -> np.ndarray:
        """Tokens of each queue (column) after j (row) windows, exact."""
        total = sum(self.weights)
        steps = [self.window * w for w in self.weights]
        frames, which = np.unique(j // FRAME, return_inverse=True)
        begun = [[divmod(int(f) * FRAME * s, total) for s in steps] for f in frames]
        whole = np.array([[b[0] for b in row] for row in begun], np.int64).reshape(len(frames), -1)[which]
        rest = np.array([[b[1] for b in row] for row in begun], np.int64).reshape(len(frames), -1)[which]
        rest = rest + (j % FRAME)[:, None] * np.array(steps, np.int64)
        whole, rest = whole + rest // total, rest % total
        missing = j * self.window - whole.sum(axis=1)
        order = np.argsort(-rest, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        return whole + (place < missing[:, None])

    def windows(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """The window (from 0) that takes the token of each number (from 0) of a queue."""
        total, step = sum(self.weights), self.window * self.weights[queue]
        j = np.array([int(t) * total // step for t in tokens.tolist()], np.int64)
        for _ in range(3):
            j = j + (self.at(j + 1)[:, queue] <= tokens) - (self.at(j)[:, queue] > tokens)
        return j


@dataclass
class Phase:
    """Windows from ``first`` on, in which the queues give tokens behind those of ``base``; one window with ``counts``, or ``length`` of them by weights."""

    first: int
    length: int
    base: list[int]
    queues: list[int]
    share: Apportionment | None
    counts: list[int] | None = None

    def given(self, j: np.ndarray, queues: int) -> np.ndarray:
        """Tokens of all queues after j windows of the phase."""
        out = np.zeros((len(j), queues), np.int64)
        out[:, self.queues] = self.share.at(j) if self.share else np.array(self.counts, np.int64) * j[:, None]
        return out


def schedule(tokens: list[int], weights: list[int], window: int) -> list[Phase]:
    """The phases that take all tokens of the queues; queues of weight 0 come when the others have run out.

    A phase ends where a queue can't fill its share of the next window, which is then
    filled on its own: a queue gives what it has, and what is missing comes from the
    others by their weights.  At most two phases a queue, and one for the last window.
    """
    done, first, out = [0] * len(tokens), 0, []
    while left := sum(tokens) - sum(done):
        queues = [q for q in range(len(tokens)) if tokens[q] > done[q] and weights[q]]
        if not queues:
            queues = [q for q in range(len(tokens)) if tokens[q] > done[q]]
            weights = [t - d for t, d in zip(tokens, done)]
        share = Apportionment([weights[q] for q in queues], window)
        room = np.array([tokens[q] - done[q] for q in queues], np.int64)

        def fits(j: int) -> bool:
            return bool((share.at(np.array([j]))[0] <= room).all())

        low, high = 0, left // window + 1
        while high - low > 1:
            low, high = ((low + high) // 2, high) if fits((low + high) // 2) else (low, (low + high) // 2)
        if low:
            out.append(Phase(first, low, list(done), queues, share))
            for q, n in zip(queues, share.at(np.array([low]))[0].tolist()):
                done[q] += n
            first += low
            if sum(done) == sum(tokens):
                break
        counts = single([t - d for t, d in zip(tokens, done)], weights, window)
        out.append(Phase(first, 1, list(done), list(range(len(tokens))), None, counts))
        done, first = [d + c for d, c in zip(done, counts)], first + 1
    return out


def single(left: list[int], weights: list[int], window: int) -> list[int]:
    """Tokens that each queue gives to one window that not all can fill by their weights."""
    out = [0] * len(left)
    while (room := min(window - sum(out), sum(left) - sum(out))) > 0:
        queues = [q for q in range(len(left)) if left[q] > out[q] and weights[q]]
        queues = queues or [q for q in range(len(left)) if left[q] > out[q]]
        parts = Apportionment([weights[q] or 1 for q in queues], room).at(np.array([1]))[0].tolist()
        for q, n in zip(queues, parts):
            out[q] += min(n, left[q] - out[q])
    return out


class Cut:
    """Pieces of the documents: rows (id, _queue, _start, _ids) to (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, phases: list[Phase], queues: int) -> None:
        self.phases, self.queues = phases, queues

    def windows(self, queue: int, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, window, offset, from, to) of all pieces of a queue's documents; from and to in tokens of the queue."""
        out = []
        for k, phase in enumerate(self.phases):
            base = phase.base[queue]
            end = self.phases[k + 1].base[queue] if k + 1 < len(self.phases) else None
            end = base + int(phase.given(np.array([phase.length]), self.queues)[0, queue]) if end is None else end
            low, high = np.maximum(begin, base), np.minimum(begin + n, end)
            doc = np.flatnonzero(low < high)
            if not len(doc):
                continue
            low, high = low[doc] - base, high[doc] - base
            if phase.share:
                own = phase.queues.index(queue)
                first, last = phase.share.windows(own, low), phase.share.windows(own, high - 1)
            else:
                first = last = np.zeros(len(doc), np.int64)
            count = last - first + 1
            j, of = ranges(first, count), np.repeat(np.arange(len(doc)), count)
            each, where = np.unique(j, return_inverse=True)
            before, after = phase.given(each, self.queues), phase.given(each + 1, self.queues)
            offsets = (np.cumsum(after - before, axis=1) - (after - before))[where, queue]
            lower = np.maximum(before[where, queue], low[of])
            upper = np.minimum(after[where, queue], high[of])
            keep = lower < upper
            shift = lower - before[where, queue]
            out.append(tuple(c[keep] for c in (doc[of], phase.first + j, offsets + shift, base + lower, base + upper)))
        return tuple(np.concatenate(c) for c in zip(*out))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, begin = (batch.column(i).to_numpy() for i in (1, 2))
            packed = batch.column(3)
            for q in np.unique(queue).tolist():
                rows = np.flatnonzero(queue == q)
                ids = [ids_of(packed[i].as_py()) for i in rows.tolist()]
                n = np.array([len(x) for x in ids], np.int64)
                doc, window, offset, low, high = self.windows(q, begin[rows], n)
                low, high = low - begin[rows][doc], high - begin[rows][doc]
                sums = [crc32(ids[d][a:b].data) for d, a, b in zip(doc.tolist(), low.tolist(), high.tolist())]
                columns = [low, high - low, np.array(sums, np.int64), n[doc], window, offset]
                yield pa.record_batch([batch.column(0).take(pa.array(rows[doc])), *(pa.array(c) for c in columns)], names=["_id", *self.NAMES])


def integer_weights(asked: list[float]) -> list[int]:
    """Whole numbers in the proportion of ``asked`` to within a 2**40th of their sum; whole numbers of a sum up to MOST_WEIGHT stay as they are."""
    exact = [Fraction(a) for a in asked]
    total = sum(exact)
    if all(a.denominator == 1 for a in exact) and total <= MOST_WEIGHT:
        return [int(a) for a in exact]
    return [max(1, round(a * (1 << 40) / total)) if a > 0 else 0 for a in exact]


def queued(encoded: DataFrame, weights: DataFrame | None, source_col: str, least_share: float) -> tuple[DataFrame, list[int], list[int]]:
    """((_task, _source, _queue, _first): where the tokens of a task's source begin in their queue; tokens and integer weights of the queues)."""
    by_task = materialize(encoded.groupBy("_task", "_source").agg(F.max(F.col("_before") + F.col("_n")).alias("_tokens")), "packing-tasks")
    sources = by_task.groupBy("_source").agg(F.sum("_tokens").alias("_all"))
    if weights is None:
        asked = sources.withColumn("_w", F.col("_all").cast("double"))
    else:
        given = weights.select(F.col(source_col).cast("string").alias("_given"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("_w"))
        given = given.groupBy("_given").agg(F.sum("_w").alias("_w"))
        asked = sources.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").select("_source", "_all", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    asked = materialize(asked, "packing-sources")
    total, mass = asked.agg(F.coalesce(F.sum("_all"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    large = (F.col("_w") >= F.lit(least_share * mass)) & (F.col("_w") > 0)
    # At most 1 / least_share rows, and one row for all the others.
    own = sorted(asked.filter(large).collect(), key=lambda r: (r._source is not None, r._source))
    others = asked.filter(~large).agg(F.coalesce(F.sum("_all"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    tokens = [*(r._all for r in own), others[0]]
    number = encoded.sparkSession.createDataFrame([(r._source, i) for i, r in enumerate(own)], "_named string, _queue int")
    numbered = by_task.join(F.broadcast(number), F.col("_source").eqNullSafe(F.col("_named")), "left").drop("_named").withColumn("_queue", F.coalesce("_queue", F.lit(len(own))))
    # In a queue by task, then by source; first the tokens of whole tasks, a row a task and queue.
    inside = Window.partitionBy("_queue", "_task").orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("_queue").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = numbered.groupBy("_queue", "_task").agg(F.sum("_tokens").alias("_m"))
    tasks = tasks.select("_queue", "_task", F.coalesce(F.sum("_m").over(along), F.lit(0)).alias("_begin"))
    starts = numbered.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(tasks, ["_queue", "_task"])
    starts = starts.select("_task", "_source", "_queue", (F.col("_begin") + F.col("_inside")).alias("_first"))
    return materialize(starts, "packing-starts"), tokens, integer_weights([*(r._w for r in own), others[1]])


def pack(
    docs: DataFrame, *, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = 1, weights: DataFrame | None = None,
    least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long but the id).

    A document is its ids and ``end_id``; its pieces are what the windows of ``window``
    tokens take of it.  All windows are full but the last, so at most ``window`` - 1
    tokens of padding arise in all.  ``weights``: (source, weight), target proportions of
    tokens; by default the sources' tokens, so that every window has the proportions of
    the corpus.  While no queue has run out, each is less than one token off its target
    at the end of every window.  Sources with less than ``least_share`` of the weight have
    one queue together, in which the tasks' shares of them follow each other; sources without
    a weight over 0 come when the others have run out.

    Null texts are empty, an empty text is its end id alone; a null source is a source; null
    ids are kept; rows that repeat are packed each; sources that tie stand by name; an empty
    table gives no rows; further columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    encoded = materialize(arrow_map(rows, Encode(tokenizer, end_id), f"_id {kind}, _source string, _task int, _before long, _n long, _ids binary"), "packing-ids")
    starts, tokens, shares = queued(encoded, weights, source_col, least_share)
    phases = schedule(tokens, shares, window)
    begun = starts.select(F.col("_task").alias("_task2"), F.col("_source").alias("_source2"), "_queue", "_first")
    same = (F.col("_task") == F.col("_task2")) & F.col("_source").eqNullSafe(F.col("_source2"))
    placed = encoded.join(broadcast_if_small(begun), same).select("_id", "_queue", (F.col("_first") + F.col("_before")).alias("_start"), "_ids")
    columns = ", ".join(f"{c} long" for c in Cut.NAMES)
    pieces = arrow_map(placed, Cut(phases, len(tokens)), f"_id {kind}, {columns}")
    return pieces.withColumnRenamed("_id", id_col)
