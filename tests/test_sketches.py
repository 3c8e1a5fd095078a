"""Sketches of spans against exact aggregates, and semi-structured results against the cases they were made of."""

import random
from collections import Counter
from datetime import date, timedelta

from drawloom.operators.draws import DrawDataset
from drawloom.operators.sketches import day_sketches, over_spans, runs_of
from drawloom.plans.backtest import Backtester, BacktestResult


def test_runs_cover_every_day_once(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([-1, 0, 1, 5, 100, 3000])) for a in (rng.randint(-200, 20_000) for _ in range(200))]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, a int, b int")
    for r in frame.select("a", "b", runs_of("a", "b", 6).alias("runs")).collect():
        days = [d for level, cell in r.runs for d in range(cell << level, (cell + 1) << level)]
        assert sorted(days) == list(range(r.a, r.b + 1))
        assert Counter(level for level, _ in r.runs if level < 6).most_common(1)[0:1] == [] or max(Counter(level for level, _ in r.runs if level < 6).values()) <= 2


def test_estimates_of_spans(spark):
    rng = random.Random(2)
    first = date(2020, 1, 1)
    rows = [(first + timedelta(days=int(rng.random() ** 2 * 400)), rng.randint(0, 4000), rng.gauss(0, 1), "hot" if rng.random() < 0.3 else f"i{rng.randint(0, 400)}") for _ in range(30_000)]
    rows += [(None, 1, 1.0, "x"), (first, None, None, None)]
    data = spark.createDataFrame(rows, "day date, d int, v double, i string").repartition(6)
    spans = [(0, first, first + timedelta(days=399)), (1, first + timedelta(days=3), first + timedelta(days=90)), (2, first + timedelta(days=7), first + timedelta(days=7)), (3, first + timedelta(days=900), first + timedelta(days=901)), (4, first, first - timedelta(days=1))]
    sketches = day_sketches(data, day="day", distinct="d", value="v", item="i")
    got = {r.span_id: r for r in over_spans(sketches, spark.createDataFrame(spans, "span_id int, first_day date, last_day date"), quantiles=[0.1, 0.5, 0.9]).collect()}
    assert sorted(got) == [0, 1, 2]
    for k, a, b in spans[:3]:
        own = [r for r in rows if r[0] and a <= r[0] <= b]
        assert got[k].n == len(own)
        exact = len({r[1] for r in own if r[1] is not None})
        assert abs(got[k].distinct - exact) <= max(2, 0.06 * exact)
        values = sorted(r[2] for r in own if r[2] is not None)
        for q, x in zip((0.1, 0.5, 0.9), got[k].quantiles):
            assert abs(sum(v <= x for v in values) / len(values) - q) < 0.04
        item, count = got[k].top[0]
        assert item == "hot" and abs(count - sum(r[3] == "hot" for r in own)) <= 0.02 * len(own)


def test_variants_come_back_unchanged(spark):
    rng = random.Random(3)
    draws = DrawDataset.of(spark, [(f"d{i}", sorted(rng.sample(range(1, 20), 6))) for i in range(30)]).draws
    result = Backtester().run(draws, 10, 3, 5, 1)
    variants = result.variants()
    assert dict(variants.dtypes)["result"] == "variant"
    back = BacktestResult.from_variants(variants, 30)
    assert back.cases.columns == result.cases.columns and back.cases.dtypes == result.cases.dtypes
    assert sorted(map(tuple, back.cases.collect())) == sorted(map(tuple, result.cases.collect()))
    odd = spark.sql("select 1 as split_id, parse_json('{\"draw\": {\"ord\": \"x\"}}') as result")
    row = BacktestResult.from_variants(odd).cases.first()
    assert row.ord is None and row.best_match is None and row.split_id == 1
