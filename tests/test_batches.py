"""Lists of tickets by Arrow batches against the expressions, and counts of splits as arrays against the rows."""

import random

import pytest
from pyspark.sql import functions as F

from drawloom.functions.arrays import greedy_diverse
from drawloom.functions.batches import diverse_tickets, uniform_tickets, weighted_tickets
from drawloom.functions.sampling import uniform_ticket, weighted_ticket
from drawloom.operators import sampling
from drawloom.operators.draws import DrawDataset, WalkForward
from drawloom.operators.sampling import TicketGenerator
from drawloom.plans.backtest import Backtester
from drawloom.schema import GeneratorError

PAIRS = "array<struct<number:int,weight:double>>"


def candidates(spark):
    rng = random.Random(3)
    rows = [(s, [(x, float(rng.choice((0, 0, 1, 2, 5)))) for x in sorted(rng.sample(range(1, 90), rng.randint(0, 40)))]) for s in (*range(-3, 300), 999_999, 1_000_000, 4_400_042, 1 << 40)]
    return spark.createDataFrame(rows, f"s long, c {PAIRS}")


def test_weighted_and_uniform_lists_equal_the_expressions(spark):
    seed, c = F.col("s"), F.col("c")
    plain = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: weighted_ticket(c, seed, t, 6))
    got = candidates(spark).select("s", weighted_tickets(c, seed, 12, 6).alias("got"), plain.alias("want")).collect()
    assert len(got) == 307 and all(r.got == r.want for r in got)
    count = F.pmod("s", F.lit(12)).cast("int") - 1
    plain = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda t: uniform_ticket(seed, t, 5, 3, 20))).otherwise(F.array().cast("array<array<int>>"))
    got = candidates(spark).select(uniform_tickets(seed, count, 5, 3, 20).alias("got"), plain.alias("want")).collect()
    assert all(r.got == r.want for r in got) and {len(r.got) for r in got} == set(range(11))


@pytest.mark.parametrize(("overlap", "most"), [(2, 100), (1, 4), (0, 3), (9, 5)])
def test_diverse_lists_equal_the_expression(spark, overlap, most):
    rng = random.Random(5)
    ticket = lambda top: [rng.choice((None, *range(1, top))) if rng.random() < 0.1 else rng.randrange(1, top) for _ in range(rng.randint(0, 6))]
    rows = [([ticket(rng.choice((4, 12, 300))) for _ in range(rng.randint(0, 30))],) for _ in range(300)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "t array<array<int>>")
    got = df.select(diverse_tickets(F.col("t"), overlap, most).alias("got"), greedy_diverse(F.col("t"), overlap, most).alias("want")).collect()
    assert all(r.got == r.want for r in got)


def test_counts_of_splits_as_arrays_equal_the_rows(spark):
    rng = random.Random(8)
    # Numbers that come late, and a stretch in which nothing new is seen.
    rows = [(str(i), rng.sample(range(1, 5 + i // 9), 3) if not 40 < i < 90 else [1, 2]) for i in range(140)]
    draws = DrawDataset.of(spark, rows).draws
    for train, test in ((1, 1), (70, 1), (20, 13), (100, 40)):
        walk = WalkForward(draws, train, test)
        lists = walk.train_lists().collect()
        assert sorted(r.split_id for r in lists) == list(range(walk.n_splits))
        want = {(r.split_id, r.number, r["count"]) for r in walk.train_frequency().collect()}
        assert {(r.split_id, x.number, x["count"]) for r in lists for x in r.seen} == want
        assert all([x.number for x in r.seen] == sorted({x.number for x in r.seen}) for r in lists)


def test_checks_of_arrays_are_those_of_rows(spark):
    six, g = [(i, 1.0) for i in range(1, 7)], TicketGenerator()
    g.check_lists(spark.createDataFrame([(six,)], f"c {PAIRS}"), F.col("c"))
    for bad, error in ((six[1:], "Not enough"), ([*six, (0, 1.0)], "Number 0 is outside"), ([*six, (40, 1.0), (39, 1.0)], "Number 39 is outside"), ([*six, (7, -1.0)], "negative: -1.0"), ([*six, (7, float("nan"))], "negative"), ([*six, (7, None)], "negative"), ([*six, (6, 1.0)], "Duplicate")):
        with pytest.raises(GeneratorError, match=error):
            g.check_lists(spark.createDataFrame([(six,), (bad,)], f"c {PAIRS}"), F.col("c"))


def test_the_backtest_evaluates_no_expression_a_number(spark, monkeypatch):
    """Numbers are hashed by the batch: before, an interpreted expression was evaluated for each number of each ticket."""

    def refused(*_, **__):
        raise AssertionError("a ticket by expressions")

    monkeypatch.setattr(sampling, "weighted_ticket", refused)
    monkeypatch.setattr(sampling, "uniform_ticket", refused)
    rng = random.Random(2)
    draws = DrawDataset.of(spark, [(str(i), rng.sample(range(1, 38), 6)) for i in range(60)]).draws
    made = Backtester().split_tickets(WalkForward(draws, 40, 1), 20, 42)
    plan = made.select("split_id", "recommended", "baseline")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan
    got = {r.split_id: r for r in made.collect()}
    assert len(got) == 20 and all(len(r.tickets) == 20 and len(r.recommended) == len(r.baseline) for r in got.values())
    seen = {r.split_id: r.seen for r in WalkForward(draws, 40, 1).train_lists().collect()}
    scored = [(k, [(x.number, 0.7 * (x["count"] / max(y["count"] for y in s)) + 0.0) for x in s]) for k, s in seen.items()]
    df = spark.createDataFrame([(k, [(n, w / (0.7 + 0.3)) for n, w in s]) for k, s in scored], f"split_id int, c {PAIRS}")
    c = F.col("c")
    want = df.select("split_id", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda t: weighted_ticket(c, F.lit(42) + F.col("split_id"), t, 6)).alias("t"))
    assert {r.split_id: r.t for r in want.collect()} == {k: r.tickets for k, r in got.items()}
