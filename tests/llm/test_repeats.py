import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from drawloom.llm import repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        spans = []
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        left, at = b"", 0
        for a, b in spans:
            left, at = left + r[at:a], b
        left += r[at:]
        out.append((len(r), len(r) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randint(10, 60)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        parts.insert(1, rng.choice(shared))
        t = "".join(parts)
        if rng.random() < 0.5 and texts:
            t = rng.choice(texts) or t
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "x", "yy"]) + t[at + rng.randint(0, 2) :]
        texts.append(t)
    return [*texts, texts[0], texts[0], None, "", "ab " * 300, "z" * 500, "z" * 70]


def rows(df):
    return [tuple(r)[1:5] for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed, length, block, hot", [(1, 64, 20, 4096), (2, 64, 32, 2), (3, 100, 50, 3), (4, 80, 10, 4096), (5, 64, 31, 1)])
def test_against_brute_force(spark, monkeypatch, seed, length, block, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = rows(repeats.remove_repeats(docs, length=length, block=block))
    assert got == brute(texts, length)  # bytes, also inside code points


def test_kept_bytes_and_clashing_columns(spark):
    t = "0123456789" * 9 + "unlike"
    docs = spark.createDataFrame([(None, t, 1, "a"), (7, "pre" + t, 2, "b"), (7, "pre" + t, 2, "b")], "doc_id long, text string, _key int, _spans string")
    got = sorted((r.doc_id is not None, bytes(r.kept)) for r in repeats.remove_repeats(docs, length=64, block=20).collect())
    assert got == [(False, b""), (True, b""), (True, b"")]
    assert repeats.remove_repeats(docs.limit(0), length=64, block=20).count() == 0


def test_extension_against_pairs():
    rng = np.random.default_rng(5)
    for _ in range(300):
        block, n = int(rng.integers(1, 9)), int(rng.integers(1, 12))
        wing = block - 1
        items = {(int(rng.integers(0, 2)), bytes(rng.choice([97, 98], rng.integers(0, wing + 1)).tolist()), bytes(rng.choice([97, 98], rng.integers(0, wing + 1)).tolist())) for _ in range(n)}
        items = sorted(items)
        many = rng.random(len(items)) < 0.2
        first, last = repeats.extend(np.array([c for c, _, _ in items]), [x for _, x, _ in items], [y for _, _, y in items], many, block)
        for k, (c, x, y) in enumerate(items):
            hit = []
            for w in range(block):
                if len(x) < wing - w or len(y) < w:
                    continue
                own = (x[len(x) - (wing - w) :], y[:w])
                same = [m for m, (d, p, q) in enumerate(items) if m != k and d == c and len(p) >= wing - w and len(q) >= w and (p[len(p) - (wing - w) :], q[:w]) == own]
                if same or many[k]:
                    hit.append(w)
            assert (first[k], last[k]) == ((hit[0], hit[-1]) if hit else (-1, -1)), (items, k)


def test_periodic_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 4)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line = "one common line in very many texts, which is longer than a window. "
    texts = ["ab" * 60_000, line * 900, *(letters(40) + line + letters(rng.randint(0, 50)) for _ in range(60)), letters(150_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert rows(repeats.remove_repeats(docs, length=64, block=32)) == brute(texts, 64)


def test_a_periodic_text_gives_few_rows():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1]), pa.array(["xyz" * 100_000])], names=["_key", "_text"])
    assert sum(b.num_rows for b in repeats.Cores(400, 192)(iter([batch]))) < 1000


def test_planted_passages_of_over_50_words(spark, tmp_path):
    """The query takes a passage in two documents from 400 bytes on, whatever its words; documents without one stay whole."""
    from drawloom.llm import registry

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkléß") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))

    def passage(size):
        """Over 50 words of exactly so many bytes."""
        out = prose(52).encode()[: size - 1]
        while len(out) < size - 1:
            out += b" " + prose(1).encode()
        out = out[: size - 1].decode("utf-8", "ignore").encode().ljust(size, b".").decode()
        assert len(out.split()) > 50
        return out

    sizes = [399, 400, 401, 575, 576, 620, 900]
    texts = []
    for k, size in enumerate(sizes):
        p = passage(size)
        # Other bytes on both sides, so that no more than the passage is shared.
        texts += [prose(90) + f"<{k}a" + p + f"a{k}>" + prose(20), prose(5) + f"<{k}b" + p + f"b{k}>" + prose(200)]
    texts += [prose(150) for _ in range(6)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(registry.queries()["op1_suffix_array_dedup"](spark, str(tmp_path)))
    assert got == brute(texts, 400)
    assert [r[1] for r in got] == [size * (size >= 400) for size in sizes for _ in range(2)] + [0] * 6
