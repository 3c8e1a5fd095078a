"""Importance resampling against a plain computation."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import pytest
from conftest import SF

from drawloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return Counter(crc32(f.encode()) for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def plain(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    bucketed = lambda texts: [sum((Counter({c % buckets: n}) for c, n in features(t).items()), Counter()) for t in texts]
    own, wanted = bucketed([t for _, t in docs]), sum(bucketed(target), Counter())
    s = sum(own, Counter())
    big_s, big_t = sum(s.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in s}
    rows = []
    for (key, text), counts in zip(docs, own):
        n = sum(counts.values())
        weight = sum(gain[b] * c for b, c in counts.items()) // n if n else 0
        h = int(sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): i + 1 for i, r in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted(((*r[:4], place.get(id(r))) for r in rows), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_whole_tables(spark, monkeypatch):
    """Many blocks and runs of blocks, too."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert got(resample.resample(docs, bench)) == want
    monkeypatch.setattr(resample, "BLOCK_FEATURES", 3000)
    monkeypatch.setattr(resample, "RUN", 2)
    assert got(resample.resample(docs.repartition(3), bench)) == want


def test_edges(spark):
    many = " ".join(f"w{i % 50}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "A b c " * 10), (None, "a B c " * 10), (6, many), (7, "naïve ÄÖ 漢字 " * 9), (8, "the the " * 3000)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, _block string, _sum int")
    bench = spark.createDataFrame([("i", "a b c the", 1), ("j", None, 2)], "item_id string, text string, doc_id int")
    assert got(resample.resample(docs.repartition(4), bench, percent=60)) == plain(rows, ["a b c the", None], 60)
    none = resample.resample(docs, bench.filter("false"), percent=60)
    assert got(none) == plain(rows, [], 60)
    assert resample.resample(docs.filter("false"), bench).count() == 0


def test_repeated_rows_each_have_a_rank(spark):
    rows = [(5, "same words again and again " * 5)] * 40 + [(i, f"other words {i} and more " * 5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([("same words",)], "text string")
    made = resample.resample(docs, bench, percent=50).collect()
    assert len(made) == 60 and sorted(r.rank for r in made if r.rank) == list(range(1, 31))
    scores = [r.score for r in sorted((r for r in made if r.rank), key=lambda r: r.rank)]
    assert scores == sorted(scores, reverse=True)


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_long_texts_in_pieces(monkeypatch, piece):
    text = "Some words, of any länge; repeated words words. " * 30
    n, counts = resample.bucket_counts(text, 997)
    monkeypatch.setattr(resample, "PIECE", piece)
    m, again = resample.bucket_counts(text, 997)
    assert n == m == len(words(text)) and (counts == again).all()
    want = Counter()
    for c, k in features(text).items():
        want[c % 997] += k
    assert {b: int(c) for b, c in enumerate(counts) if c} == want
