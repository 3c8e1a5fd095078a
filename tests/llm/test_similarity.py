import random

import numpy as np
import pytest

from drawloom.llm import components as components_module
from drawloom.llm import embeddings, jaccard, shingles
from drawloom.llm.components import components


def naive_set(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def texts(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    common = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join([common, *(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))]))
    return [*out, None, "", " \n\t", "One", "one", "two words", "Two\tWORDS", "x " * 50, "x " * 60, "É É é", out[0].upper()]


def brute(rows, k, percent):
    sets = {i: naive_set(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed, k, percent, tile, hot", [(1, 3, 90, 256, 100_000), (2, 5, 80, 3, 4), (3, 1, 50, 4, 100_000), (4, 2, 100, 2, 5)])
def test_jaccard_against_all_pairs(spark, monkeypatch, seed, k, percent, tile, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard.join_classes, "__kwdefaults__", jaccard.join_classes.__kwdefaults__ | {"tile": tile})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, k=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("seed, k, percent, tile", [(1, 3, 90, 256), (2, 5, 60, 3), (3, 1, 40, 4)])
def test_link_counts_against_all_pairs(spark, monkeypatch, seed, k, percent, tile):
    rows = list(enumerate(texts(seed)))
    docs = spark.createDataFrame([*rows, rows[0], rows[5]], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard.join_classes, "__kwdefaults__", jaccard.join_classes.__kwdefaults__ | {"tile": tile})
    got = jaccard.near_duplicates(docs, k=k, percent=percent, count=True).collect()
    own = [naive_set(t, k) for _, t in rows]
    weight = [2 if i in (0, 5) else 1 for i in range(len(rows))]
    want = {i: sum(weight[j] for j, y in enumerate(own) if x and y and 100 * len(x & y) >= percent * len(x | y)) - bool(x) for i, x in enumerate(own)}
    assert len(got) == len(rows) + 2 and {r.doc_id: r.n_links for r in got} == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, percent)


@pytest.mark.parametrize("copies, stranger_share", [(120, 0), (120, 0.2)])
def test_a_group_of_near_copies_is_sent_a_bounded_number_of_times(spark, monkeypatch, copies, stranger_share):
    rng = random.Random(copies)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(copies):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{i}"
        if rng.random() < stranger_share:  # of the same first half: shares many shingles, links with its like only
            own[60:] = [f"s{i % 3}-{j}" for j in range(60)]
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent = []
    real = jaccard.paired
    monkeypatch.setattr(jaccard, "paired", lambda *a: sent.append((real(*a), len(a))) or sent[-1][0])
    tile = 4
    monkeypatch.setattr(jaccard.join_classes, "__kwdefaults__", jaccard.join_classes.__kwdefaults__ | {"tile": tile})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, k=3, percent=80).collect()}
    assert got == brute(rows, 3, 80)
    groups = {"part", "token"}
    most = [s.groupBy(*(groups & set(s.columns)), "_cid").count().agg({"count": "max"}).first()[0] for s, _ in sent]
    if stranger_share:
        assert len(sent) > 2  # what the ring left apart met the others
    else:
        assert len(sent) == 4 and most[0] <= 3 and most[2] <= 3 and most[1] is None and most[3] is None


def test_what_a_ring_leaves_apart_meets_all_others(spark):
    # 40 classes in one group of 10 tiles: 30 are connected, 7 stand alone, 3 are a component of their own.
    rows = spark.createDataFrame([(c, 1, 1, 10, c % 10) for c in range(40)], "_cid long, part long, _n long, _tiles int, _tile int")
    parts = spark.createDataFrame([(c, 0) for c in range(30)] + [(c, 30) for c in (30, 31, 32)], "node long, component long")
    cells = {}
    for r in jaccard.strangers(rows, "part", parts, 4).collect():
        cells.setdefault((r.i, r.j), []).append((r._cid, r.tile))
    met = {frozenset((a, b)) for (i, j), own in cells.items() for a, s in own for b, t in own if a != b and (i == j or s != t)}
    assert met == {frozenset((a, b)) for a in range(30, 40) for b in range(40) if a != b}
    assert all(len(own) <= 24 for own in cells.values())
    alone = parts.filter("component = 0")
    assert jaccard.strangers(rows.filter("_cid < 30"), "part", alone, 4).count() == 0


def test_keep_one_and_edges(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (1, "A b c d e f g", "y"), (None, "a b c d e f g", "z"), (5, None, None), (6, None, None), (7, "", ""), (8, "other words here stand alone now", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cid string")
    got = jaccard.keep_one(docs, k=5, percent=80)
    assert got.columns == docs.columns and sorted((r.doc_id, r._cid or "") for r in got.collect()) == [(1, "y"), (5, ""), (6, ""), (7, ""), (8, "q")]
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.near_duplicates(docs).collect()) == [(-1, 1), (1, 1), (1, 1), (3, 1), (5, 5), (6, 6), (7, 7), (8, 8)]
    assert jaccard.keep_one(docs.limit(0)).count() == 0 == jaccard.near_duplicates(docs.limit(0)).count()
    with pytest.raises(ValueError):
        jaccard.near_duplicates(docs, percent=0)


def test_shingle_sets():
    pool = texts(7)
    for k in (1, 2, 3, 5):
        for t, own in zip(pool, shingles.sets([t or "" for t in pool], k)):
            assert len(own) == len(naive_set(t, k)) and (np.diff(own.astype(object)) > 0).all()
    a, b = shingles.sets(["a b c d", "b c d e"], 2)
    assert shingles.common(a, b) == 2 and shingles.identity(a) != shingles.identity(b) and shingles.identity(a[:0]) == 0


def test_partner_rule_and_suffix_filter_lose_nothing():
    rng = np.random.default_rng(1)
    for _ in range(400):
        p, m = int(rng.choice([50, 80, 90, 100])), int(rng.integers(1, 14))
        token, n = rng.integers(0, 3, m), rng.integers(1, 40, m)
        place = np.array([rng.integers(0, x) for x in n])
        o = np.lexsort((n, token))
        token, n, place = token[o], n[o], place[o]
        fine = lambda i, j: (n[i] - place[i]) * (100 + p) >= p * (n[i] + n[j]) and (n[j] - place[j]) * (100 + p) >= p * (n[i] + n[j])
        want = [any(j != i and token[j] == token[i] and fine(i, j) for j in range(m)) for i in range(m)]
        assert jaccard.Viable(p).viable(token, n, place).tolist() == want
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64) << np.uint64(58)) for _ in range(2))
        assert jaccard.suffix_bound(x, y) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("percent", [1, 5, 24, 25, 34, 49, 50, 80, 100])
def test_suffix_filter_connects_sets_of_any_allowed_lengths(percent):
    pool = np.random.default_rng(3).integers(0, 1 << 64, 4000, dtype=np.uint64)
    for n in (1, 15, 63, 64, 127, 128, 255, 1000):
        m = min(100 * n // percent, len(pool))  # a subset of n has a similarity of n / m to it
        both = [np.sort(pool[:n]), np.sort(pool[:m])]
        for own in (both, both[::-1]):
            root = jaccard.alike([jaccard.histogram(x) for x in own], np.zeros(2, int), False, percent)
            assert root[0] == root[1] >= 0


def test_a_shingle_with_very_many_rows_passes_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HELD", 30)
    token = np.repeat([1, 2, 3], [40, 100, 5])
    table = pa.table({"_token": token, "_cid": np.arange(145), "_n": np.where(np.arange(145) % 2, 10, 1000), "_place": np.zeros(145, int), "_salt": np.full(145, -1)})
    out = pa.Table.from_batches(list(jaccard.Viable(90)(iter(table.to_batches(max_chunksize=20)))))
    assert {1, 2} <= set(out["_token"].to_pylist()) and out["_token"].to_pylist().count(2) == 100
    assert len(set(out["_cid"].to_pylist())) == out.num_rows >= 140


@pytest.mark.parametrize("chunk, degree", [(1_000_000, 400), (7, 3), (1, 1)])
def test_components(spark, monkeypatch, chunk, degree):
    monkeypatch.setattr(components_module, "CHUNK", chunk)
    monkeypatch.setattr(components_module, "DEGREE", degree)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(7, 7), (7, 7)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + i, 3000) for i in range(50)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    real = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for x in real}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_table_of_frequent_shingles_is_bounded(spark):
    docs = spark.createDataFrame([(" ".join(f"w{j}" for j in range(i, 60)),) for i in range(60)], "_text string")
    every = jaccard.frequent_shingles(docs, 1)
    few = jaccard.frequent_shingles(docs, 1, size=20)
    assert len(every[0]) == 57 and 0 < len(few[0]) <= 20 and few[1].min() > every[1].min() and (np.diff(few[0].astype(object)) > 0).all()


def brute_vectors(rows, threshold):
    ok = lambda v: v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
    link = lambda a, b: a[2] is not None and a[2] == b[2] and ok(a[1]) and ok(b[1]) and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold
    n = len(rows)
    near = [[j for j in range(n) if j != i and link(rows[i], rows[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), low, low == rows[i][0]))
    return sorted(out)


@pytest.mark.parametrize("tile", [4, None])
def test_vectors_against_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 40))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=40) * rng.choice([0.1, 0.35])).tolist(), int(rng.integers(3)) if i % 11 else None) for i in range(120)]
    rows += [(200 + i, rows[5][1], rows[5][2]) for i in range(7)] + [(300, None, 1), (301, [0.0] * 40, 1), (302, [None] * 40, 1), (303, [float("nan")] * 40, 1), (304, [], 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [1e-300] * 40, 1), (308, [1e300] * 40, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df, threshold=0.93, tile=tile).collect())
    want = brute_vectors([r for r in rows if r[0] < 307], 0.93)
    assert [r for r in got if r[0] < 307] == want
    assert {r[0]: r[1] for r in got}[307] >= 1 and len(got) == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_bounds_keep_every_close_pair():
    rng = np.random.default_rng(4)
    x = embeddings.unit(rng.normal(size=(60, 48)) + 2 * rng.normal(size=48))
    p = x @ embeddings.axes(x.T @ x)
    i, j, c = embeddings.close_pairs(p, p, 0.8)
    assert set(zip(i.tolist(), j.tolist())) >= {(a, b) for a in range(60) for b in range(60) if x[a] @ x[b] >= 0.8}
    assert np.allclose(c, (x @ x.T)[i, j])


@pytest.mark.parametrize("k", [1, 3, 5, 8])
def test_shingle_sets_of_few_words_alone_in_a_piece(k):
    for text in ("", "a", "a b", "a b c", "a b c d"):
        assert [len(x) for x in shingles.sets([text], k)] == [len(naive_set(text, k))]
    long = "word " * (shingles.PIECE // 5 + 1)
    got = shingles.sets([long, "a b", long, "a b c", "a b"], k)
    assert [x.tolist() for x in got] == [shingles.sets([t], k)[0].tolist() for t in (long, "a b", long, "a b c", "a b")]
    assert got[1].tolist() == got[4].tolist() == shingles.sets(["a b", "more words than k in the same piece of the text here"], k)[0].tolist()


def test_wide_vectors_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 768))
    rows = [(i, (centres[i % 4] + rng.normal(size=768) * 0.2).tolist(), i % 2, "x", i) for i in range(60)]
    tie = [0.93, float(np.sqrt(1 - 0.93**2))]
    rows += [(100, [1.0, 0.0], 9, "x", 0), (101, tie, 9, "x", 0), (102, [tie[0] - 1e-7, float(np.sqrt(1 - (tie[0] - 1e-7) ** 2))], 9, "x", 0), (100, [1.0, 0.0], 9, "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, _class string, _n long").repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df, tile=7).collect())
    assert [r for r in got if r[0] < 100] == brute_vectors(rows[:60], 0.93)
    exact = float(np.dot(embeddings.unit(np.array([[1.0, 0.0]]))[0], embeddings.unit(np.array([tie]))[0])) >= 0.93
    assert [r[1] for r in got if r[0] >= 100] == ([2, 2, 3, 1] if exact else [1, 1, 1, 1])


def test_comparison_in_parts_equals_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = (embeddings.unit(rng.normal(size=(n, 24)) + 1.5) for n in (50, 33))
    whole = {(i, j) for i in range(50) for j in range(33) if x[i] @ y[j] >= 0.9}
    monkeypatch.setattr(embeddings, "PAIRS", 100)
    assert {(i, j) for i, j, c in zip(*embeddings.all_close_pairs(x, y, 0.9, False)) if c >= 0.9} == whole
    i, j, c = embeddings.all_close_pairs(x, x, 0.9, True)
    assert {(a, b) for a, b, v in zip(i, j, c) if v >= 0.9} == {(a, b) for a in range(50) for b in range(a + 1, 50) if x[a] @ x[b] >= 0.9}
