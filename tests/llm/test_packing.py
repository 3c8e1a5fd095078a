"""Packing against a plain deficit round-robin, the tokenizers library and the rules of its contract."""

import random
from collections import defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from drawloom.llm import packing
from drawloom.llm.packing import Apportionment, Cut, Phase, encoder, integer_weights, schedule

TEXTS = [
    "Hello world's tests, we're 12345 here!", "", " ", "\n\n  \t x", "<|endoftext|> and <|endoftext|>", "naïve façade — 北京 🙂👩‍👩‍👧 ​ x",
    "a" * 3000, "́༺ ½ ² Ⅷ ٣", "don't DON'T it'S 'll", "tabs\t\ttabs \r\n end ", "\x00\x01\x7f\x80", "word " * 2000,
]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.TOKENIZER).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    encode, known = encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    rng = random.Random(1)
    alphabets = ["ab '\n\t0", "éß漢字🙂 ", "".join(map(chr, range(32, 0x250))), "".join(map(chr, range(0x2000, 0x2070)))]
    made = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60))) for _ in range(3000)]
    made += ["".join(chr(c) for c in (rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000))) for _ in range(30))) for _ in range(500)]
    texts = TEXTS + made + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        assert encode(text).tolist() == known.encode(text, add_special_tokens=False).ids


def test_other_files_are_left_to_the_library():
    encode = encoder("/opt/tokenizers/word_bpe_49k.json")
    from tokenizers import Tokenizer

    assert encode("Hello there").tolist() == Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json").encode("Hello there", add_special_tokens=False).ids


def round_robin(weights, window, windows):
    """Tokens of each queue in each window: credits, whole tokens, then the largest deficits; deficits are carried."""
    total, deficit, out = sum(weights), [Fraction(0)] * len(weights), []
    for _ in range(windows):
        deficit = [d + Fraction(window * w, total) for d, w in zip(deficit, weights)]
        # A queue whose deficit is under 0 was served in advance.
        given = [max(0, d.__floor__()) if d >= 0 else 0 for d in deficit]
        order = sorted(range(len(weights)), key=lambda q: (-(deficit[q] - given[q]), q))
        for q in order[: window - sum(given)]:
            given[q] += 1
        deficit = [d - g for d, g in zip(deficit, given)]
        assert all(abs(d) < 1 for d in deficit)
        out.append(given)
    return out


@pytest.mark.parametrize("weights", [[1], [1, 1], [700, 33, 31, 5, 9, 222], [3, 1, 1, 1, 1, 1, 1], list(range(8, 40))])
def test_apportionment_is_a_round_robin_with_carried_deficits(weights):
    window, n = 256, 300
    got = Apportionment(weights, window).at(np.arange(n + 1))
    each = np.diff(got, axis=0)
    assert (each >= 0).all() and (each.sum(axis=1) == window).all()
    for q, w in enumerate(weights):
        for j in range(n + 1):
            assert abs(got[j, q] - Fraction(j * window * w, sum(weights))) < 1
    plain = np.cumsum(round_robin(weights, window, n), axis=0)
    assert (np.abs(plain - got[1:]) <= 1).all()  # both are whole tokens less than one off the same share
    for q in range(len(weights)):
        tokens = np.arange(int(got[40, q]))
        j = Apportionment(weights, window).windows(q, tokens)
        assert (got[j, q] <= tokens).all() and (got[j + 1, q] > tokens).all()


def test_apportionment_is_exact_far_out():
    weights = [15 * 10**12, 10**13, 7 * 10**12 + 5]
    share, j = Apportionment(weights, 2048), np.array([10**10, 10**10 + 63, 10**10 + 64])
    got = share.at(j)
    for row, k in zip(got.tolist(), j.tolist()):
        assert sum(row) == k * 2048 and all(abs(g - Fraction(k * 2048 * w, sum(weights))) < 1 for g, w in zip(row, weights))


@pytest.mark.parametrize("tokens, weights", [([1000, 300, 50], [1, 1, 1]), ([5000, 0, 77], [5000, 0, 77]), ([1, 2, 3], [1, 0, 0]), ([640, 640], [1, 1]), ([3, 900, 10], [5, 1, 0]), ([0], [0]), ([1], [9])])
def test_schedule_takes_everything(tokens, weights):
    window = 64
    phases = schedule(tokens, weights, window)
    taken, first = [0] * len(tokens), 0
    for p in phases:
        assert p.first == first and p.base == taken
        steps = np.diff(p.given(np.arange(p.length + 1), len(tokens)), axis=0)
        full = steps.sum(axis=1) == window
        assert (steps >= 0).all() and full[:-1].all() and (full[-1] or p is phases[-1])
        taken = [t + int(s) for t, s in zip(taken, steps.sum(axis=0))]
        first += p.length
    assert taken == tokens


def pieces_of(rows):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    return by_doc, by_sequence


def holds(rows, texts, window):
    """The rules: each id in one piece, checksums, gapless offsets, full windows but the last."""
    by_doc, by_sequence = pieces_of(rows)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids, at = np.array([*library(texts[d] or ""), 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (s == len(by_sequence) - 1 and at < window)


def test_pack_keeps_the_rules_and_the_proportions(spark):
    rng = random.Random(4)
    texts = {i: (None if i == 3 else " ".join(rng.choices(["alpha", "beta", "naïve", "42"], k=rng.randint(0, 80)))) for i in range(150)}
    texts[7], texts[8] = "", "long text " * 900
    source = {i: ["a", "b", None, "c"][0 if i % 3 == 0 else i % 4] for i in texts}
    docs = spark.createDataFrame([(i, t, source[i], i) for i, t in texts.items()], "doc_id long, text string, source string, sequence_id int")
    rows = packing.pack(docs.repartition(5), window=64).collect()
    holds(rows, texts, 64)
    total, seen = defaultdict(int), defaultdict(int)
    for r in rows:
        total[source[r.doc_id]] += r.length
    every, last = sum(total.values()), max(r.sequence_id for r in rows)
    for k in range(last):
        for r in rows:
            if r.sequence_id == k:
                seen[source[r.doc_id]] += r.length
        assert all(abs(seen[s] - (k + 1) * 64 * total[s] / every) < 1 for s in total)


def test_pack_to_given_weights(spark):
    texts = {i: "one two three four five six" for i in range(90)}
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in texts.items()], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    rows = packing.pack(docs.repartition(4), window=16, weights=weights).collect()
    holds(rows, texts, 16)
    a, windows = 0, sorted({r.sequence_id for r in rows})
    for k in windows[:18]:
        a += sum(r.length for r in rows if r.sequence_id == k and r.doc_id % 2 == 0)
        assert abs(a - (k + 1) * 12) < 1
    only = packing.pack(docs, window=16, weights=weights.filter("source = 'b'")).collect()
    holds(only, texts, 16)
    assert min(r.sequence_id for r in only if r.doc_id % 2 == 0) >= max(r.sequence_id for r in only if r.doc_id % 2) > 0


def test_pack_many_small_sources_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr("drawloom.llm.common.BROADCAST_ROWS", 0)
    texts = {i: "x y z " * (i % 5) for i in range(300)}
    docs = spark.createDataFrame([(i, t, f"s{i % 97:03}") for i, t in texts.items()], "doc_id long, text string, source string")
    rows = packing.pack(docs.repartition(6), window=32, least_share=1 / 4).collect()
    holds(rows, texts, 32)
    twice = spark.createDataFrame([(5, "same text here", "a")] * 40, "doc_id long, text string, source string")
    again = packing.pack(twice.repartition(3), window=8).collect()
    n = len(library("same text here")) + 1
    assert sum(r.length for r in again) == 40 * n and {r.doc_tokens for r in again} == {n}
    assert packing.pack(docs.filter("false")).count() == 0


def test_integer_weights():
    assert integer_weights([3.0, 5.0]) == [3, 5] and integer_weights([0.0, 2.0]) == [0, 2]
    w = integer_weights([0.1, 0.2, 0.7])
    assert all(abs(x / sum(w) - a) < 2**-38 for x, a in zip(w, (0.1, 0.2, 0.7)))


def test_cut_of_one_queue():
    cut = Cut([Phase(0, 3, [0], [0], Apportionment([1], 10)), Phase(3, 1, [30], [0], None, [4])], 1)
    doc, window, offset, low, high = cut.windows(0, np.array([0, 25]), np.array([25, 9]))
    assert list(zip(doc, window, offset, low, high)) == [(0, 0, 0, 0, 10), (0, 1, 0, 10, 20), (0, 2, 0, 20, 25), (1, 2, 5, 25, 30), (1, 3, 0, 30, 34)]
