"""As-of and interval joins and grouping sets against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drawloom.operators import temporal
from drawloom.operators.stats import frequency_cube, pair_cube


@pytest.mark.parametrize("by", [[], ["k"]])
def test_as_of_equals_a_loop(spark, by):
    rng = random.Random(len(by))
    key = lambda: "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
    history = [(key(), None if i % 40 == 0 else rng.randint(0, 300), i, f"h{i}") for i in range(400)]
    points = [(i, key(), None if i % 50 == 0 else rng.randint(-5, 310)) for i in range(500)] + [(9, "hot", 100)] * 30
    left = spark.createDataFrame(points, "id int, k string, at int").repartition(4)
    right = spark.createDataFrame(history, "k string, since int, n int, name string").repartition(3)
    got = temporal.as_of(left, right, at="at", since="since", by=by, ties=["n"]).collect()

    def latest(k, at):
        past = [h for h in history if h[1] is not None and at is not None and h[1] <= at and (not by or h[0] == k)]
        return max(past, key=lambda h: (h[1], h[2])) if past else None

    want = sorted(((i, k, at, latest(k, at)) for i, k, at in points), key=repr)
    assert sorted(((r.id, r.k, r.at, tuple(r.latest) if r.latest else None) for r in got), key=repr) == want
    assert temporal.as_of(left, right.filter("false"), at="at", since="since", by=by).filter("latest is not null").count() == 0
    assert temporal.as_of(left.filter("false"), right, at="at", since="since", by=by).count() == 0


def test_within_equals_a_loop(spark):
    rng = random.Random(7)
    spans = [(i, b := rng.randint(-500, 5000), b + rng.choice([0, 1, 2, 7, 64, 4000, -3])) for i in range(120)] + [(900, 0, 10**12), (901, None, 5), (902, 5, None)]
    points = [(i, rng.randint(-600, 6000)) for i in range(700)] + [(9000, None), (9001, 10**12)]
    left = spark.createDataFrame(points, "id int, at long").repartition(3)
    right = spark.createDataFrame(spans, "span int, b long, e long").repartition(4)
    got = sorted((r.id, r.span) for r in temporal.within(left, right, at="at", begin="b", end="e").collect())
    assert got == sorted((i, s) for i, at in points for s, b, e in spans if None not in (at, b, e) and b <= at <= e)
    copies = right.filter("e >= b").count()
    assert len(got) == len(set(got)) and copies < 120
    assert temporal.within(left, right.filter("false"), at="at", begin="b", end="e").count() == 0


def test_grouping_sets_equal_counters(spark):
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(1, 8), rng.randint(1, 4))), rng.choice([None, "2023-12-31", "2024-01-05", "2024-02-01"])) for _ in range(200)]
    draws = spark.createDataFrame(rows, "numbers array<int>, date string").repartition(3)
    when = lambda d: (int(d[:4]), int(d[5:7])) if d else (None, None)
    want = Counter()
    for numbers, d in rows:
        y, m = when(d)
        for n in numbers:
            want.update([(n, y, m, 0), (n, y, None, 1), (n, None, None, 3), (None, None, None, 7)])
    got = frequency_cube(draws, [["number", "year", "month"], ["number", "year"], ["number"], []]).collect()
    assert {tuple(r)[:4]: r["count"] for r in got} == want and len(got) == len(want)
    want = Counter()
    for numbers, d in rows:
        for a in numbers:
            for b in numbers:
                if a < b:
                    want.update([(a, b, when(d)[0], 0), (a, b, None, 1), (None, None, None, 7)])
    got = pair_cube(draws).collect()
    assert {tuple(r)[:4]: r["count"] for r in got} == want and len(got) == len(want)
    assert [r["count"] for r in frequency_cube(draws.filter("false"), [["number"], []]).collect()] in ([], [0])
    assert draws.filter(F.size("numbers") == 1).count() > 0
