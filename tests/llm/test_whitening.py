"""Whitening against eigenvectors of the whole covariance."""

import numpy as np
import pyarrow as pa
import pytest

from drawloom.llm import whitening
from drawloom.llm.whitening import Model, Summary, by_length, exact_sums, summarise


def plain(rows, k):
    """n, deviations, whitened (up to sign), explained of whole vectors, by numpy on everything at once."""
    x = np.floor(256 * np.array(rows, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), white, values[:k] / values.sum()


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [None if c is None else float(c) for c in r]) for i, r in rows], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("dims, n, merged_bytes", [(6, 500, 1), (6, 500, 1 << 27), (5, 3, 1), (2, 40, 1)])
def test_equals_the_whole_covariance(spark, monkeypatch, dims, n, merged_bytes):
    monkeypatch.setattr(whitening, "MERGED_BYTES", merged_bytes)
    rng = np.random.default_rng(dims + n)
    rows = (rng.normal(size=(n, dims)) * np.arange(1, dims + 1) + 3).astype(np.float32)
    rows = np.concatenate([rows, rows[: n // 3]])
    got = whitening.whiten(frame(spark, list(enumerate(rows.tolist()))).repartition(9)).collect()
    k = min(4, dims)
    size, deviations, white, explained = plain(rows, k)
    assert len(got) == len(rows) * k
    signs = {}
    for r in got:
        c = r.component - 1
        assert (r.n, r.deviation) == (size, deviations[r.vec_id])
        if explained[c] < 1e-12:
            assert r.whitened is None
            continue
        assert r.explained == pytest.approx(explained[c], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(white[r.vec_id, c]), rel=1e-7, abs=1e-9)
        assert r.identity_error < 1e-9
        if abs(r.whitened) > 1e-3:
            signs.setdefault(c, set()).add(np.sign(r.whitened) == np.sign(white[r.vec_id, c]))
    assert all(len(s) == 1 for s in signs.values())


def test_merging_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, size=(700, 8))
    whole = Summary.of(x)
    parts = [Summary.of(p) for p in np.split(x, [1, 3, 400, 650])]
    left = parts[0]
    for p in parts[1:]:
        left = left.merged(p)
    right = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3].merged(parts[4])))
    for s in (left, right):
        assert s.n == 700 and s.sums.tolist() == x.sum(axis=0).tolist() and len(s.values) == 8
        assert np.allclose(s.values, whole.values, rtol=1e-12)
        assert np.allclose(s.vectors.T * s.values**2 @ s.vectors, whole.vectors.T * whole.values**2 @ whole.vectors)


def test_large_numbers_stay_exact():
    x = np.array([[1 << 61, -(1 << 61)], [(1 << 61) - 1, 3]])
    assert exact_sums(x).tolist() == [(1 << 62) - 1, 3 - (1 << 61)]
    m = Model(3, np.array([5, 7], object), np.eye(2), np.ones(2), 2.0)
    assert m.differences(x).tolist() == [[3 * int(a) - 5, 3 * int(b) - 7] for a, b in x.tolist()]
    assert m.deviations(m.differences(np.array([[10**6, 1]]))) == [(3 * 10**6 - 5) ** 2 + 16]
    with pytest.raises(OverflowError):
        m.deviations(m.differences(x))


def test_summaries_of_batches(monkeypatch):
    monkeypatch.setattr(whitening, "CHUNK", 8)
    monkeypatch.setattr(whitening.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 4})()))
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, size=(50, 3))
    batches = [pa.record_batch([pa.array(p.tolist(), pa.list_(pa.int64()))], names=["x"]) for p in np.split(x, 4 * [0] + [20])]
    (made,) = summarise(iter(batches))
    row = made.to_pylist()[0]
    assert (row["_n"], row["_node"], [int(s) for s in row["_sums"]]) == (50, 4, x.sum(axis=0).tolist())
    assert np.allclose(np.frombuffer(row["_values"]), Summary.of(x).values)
    assert list(summarise(iter([]))) == []


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [3.0, 5.0]), (7, [3.0, 5.0]), (None, [-1.0, 0.5]), (8, [-0.0, 0.001])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(2 * ["1", "7", "7", "8", "None"])
    assert {r.n for r in got} == {4}
    mixed = whitening.whiten(frame(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 7.0]), (5, [0.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in mixed) == [(1, 1, 2), (2, 1, 2), *((i, c, 3) for i in (3, 4, 5) for c in (1, 2))]
    same = whitening.whiten(frame(spark, [(1, [4.0, 4.0]), (2, [4.0, 4.0])])).collect()
    assert len(same) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, 0.0, None, 0) for r in same)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(r.vec_id for r in huge) == [2, 3]
    assert whitening.whiten(frame(spark, rows).filter("false")).count() == 0
    clash = frame(spark, [(1, [1.0]), (2, [3.0])]).selectExpr("*", "1 as component", "2 as _x", "3 as _dims")
    assert len(whitening.whiten(clash).collect()) == 2


def test_vectors_by_length():
    column = pa.array([[1, 2], [], [3], [4, 5]], pa.list_(pa.int64()))
    got = {d: x.tolist() for d, x in by_length(column).items()}
    assert got == {1: [[3]], 2: [[1, 2], [4, 5]]} and {d: x.tolist() for d, x in by_length(column.slice(2)).items()} == {1: [[3]], 2: [[4, 5]]}
