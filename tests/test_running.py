"""Positions, running sums, gaps, diverse choice and reservoirs against plain loops."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from drawloom.operators import diversity, running, sampling
from drawloom.operators.diversity import OptimizerConfig, TicketOptimizer, first_independent, subsets
from drawloom.operators.draws import DrawDataset, WalkForward
from drawloom.operators.sampling import RandomBaseline, TicketGenerator
from drawloom.operators.scoring import NumberPredictor
from drawloom.operators.stats import number_gaps, number_recency
from drawloom.plans.recommend import RecommendationEngine
from drawloom.schema import BaselineError


def made_draws(spark, n, seed=1, numbers=9):
    rng = random.Random(seed)
    rows = [(f"d{i}", tuple(sorted(rng.sample(range(1, numbers + 1), rng.randint(1, 4))))) for i in range(n)]
    return rows, DrawDataset.of(spark, rows).draws.repartition(5)


def test_positions_with_a_hot_day_and_repeated_rows(spark):
    rng = random.Random(2)
    rows = [("2024-01-01" if i % 3 else f"2024-01-{rng.randint(1, 28):02}", rng.randint(0, 500)) for i in range(3000)]
    rows += [("2024-01-02", 7)] * 1500
    got = running.ranked(spark.createDataFrame(rows, "day string, k int").repartition(7), F.col("day"), F.col("k")).collect()
    got.sort(key=lambda r: r.ord)
    assert [r.ord for r in got] == list(range(4500))
    assert [(r.day, r.k) for r in got] == sorted(rows)
    assert running.ranked(spark.createDataFrame([], "day string, k int"), F.col("day")).count() == 0
    nulls = spark.createDataFrame([(None, 2), ("b", 1), (None, 1)], "day string, k int")
    assert [(r.day, r.k) for r in sorted(running.ranked(nulls, F.col("day"), F.col("k")).collect(), key=lambda r: r.ord)] == [(None, 1), (None, 2), ("b", 1)]


def test_positions_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(running, "BROADCAST_ROWS", 0)
    got = running.ranked(spark.range(100).repartition(3), F.col("id").desc()).collect()
    assert all(r.ord == 99 - r.id for r in got)


@pytest.mark.parametrize("width", [1, 4, 7, 1000])
def test_running_equals_a_loop(spark, monkeypatch, width):
    monkeypatch.setattr(running, "width_of", lambda last: width)
    rng = random.Random(width)
    events = {(b, x): (rng.randint(1, 5), rng.randint(0, 99)) for b in "abc" for x in rng.sample(range(40), rng.randint(1, 20))}
    events[("rare", 3)] = (1, 1)
    frame = spark.createDataFrame([(b, x, n, v) for (b, x), (n, v) in events.items()], "b string, x int, n long, v long")
    got = {(r.b, r.x): (r.n, r.v) for r in running.running(frame, "b", "x", 39, total="n", latest="v").collect()}
    want = {}
    for b in {b for b, _ in events}:
        n, v = 0, None
        for x in range(40):
            if (b, x) in events:
                n, v = n + events[b, x][0], max(events[b, x][1], -1 if v is None else v)
            if v is not None:
                want[b, x] = (n, v)
    assert got == want
    assert running.running(frame.filter("false"), "b", "x", 39, total="n", latest="v").count() == 0


@pytest.mark.parametrize("train, test", [(1, 1), (40, 1), (40, 7), (99, 1)])
def test_training_statistics_equal_a_loop(spark, train, test):
    rows, draws = made_draws(spark, 100)
    walk = WalkForward(draws, train, test)
    got = {(r.split_id, r.number): (r["count"], r.last_ord) for r in walk.train_statistics().collect()}
    gaps = {(r.split_id, r.number): (r.gap, r.recency) for r in walk.train_recency().collect()}
    want = {}
    for k in range(walk.n_splits):
        for i, (_, numbers) in enumerate(rows[: train + k * test]):
            for n in numbers:
                want[k, n] = (want.get((k, n), (0, 0))[0] + 1, i)
    assert got == want
    assert gaps == {(k, n): (train + k * test - 1 - last, 1 / (1 + (train + k * test - 1 - last))) for (k, n), (_, last) in want.items()}


def test_gaps_and_recency(spark):
    rows, draws = made_draws(spark, 120, 3)
    seen, want = {}, {}
    for i, (_, numbers) in enumerate(rows):
        for n in numbers:
            want[i, n] = i - seen[n] - 1 if n in seen else None
            seen[n] = i
    assert {(r.ord, r.number): r.gap for r in number_gaps(draws).collect()} == want
    recency = number_recency(draws)
    assert {r.number: r.gap for r in recency.collect()} == {n: 119 - i for n, i in seen.items()}
    counts = spark.createDataFrame([(n, 10) for n in seen], "number int, count long")
    scores = {r.number: r.score for r in NumberPredictor(0.0, 1.0).score_numbers(counts, recency).collect()}
    assert scores == {n: pytest.approx(1 / (120 - i)) for n, i in seen.items()}
    assert number_gaps(draws.filter("false")).count() == 0 == number_recency(draws.filter("false")).count()


def greedy(tickets, overlap, most):
    out = []
    for t in dict.fromkeys(tuple(sorted(t)) for t in tickets):
        if len(out) < most and all(len(set(s) & set(t)) <= overlap for s in out):
            out.append(t)
    return out


@pytest.mark.parametrize("overlap", [0, 2, 4])
def test_diverse_choice_equals_the_sequential_rule(spark, overlap):
    rng = random.Random(overlap)
    rows = [rng.sample(range(1, 16), rng.randint(1, 7)) for _ in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "pos int, ticket array<int>").repartition(6)
    for most in (9, 2000):
        got = TicketOptimizer(OptimizerConfig(overlap, most)).optimize(frame).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(len(got)))
        assert [tuple(r.ticket) for r in got] == greedy(rows, overlap, most)


def test_diverse_choice_with_a_hot_subset(spark, monkeypatch):
    """A third of the tickets hold the same numbers, and the list is looked at in many stretches."""
    monkeypatch.setattr(diversity, "AHEAD", 2)
    rng = random.Random(5)
    rows = [sorted({1, 2, 3, *rng.sample(range(4, 30), 3)}) if i % 3 == 0 else sorted(rng.sample(range(1, 30), 6)) for i in range(900)]
    frame = spark.createDataFrame([(5 + 3 * i, t) for i, t in enumerate(rows)], "pos int, ticket array<int>").repartition(6)
    got = TicketOptimizer(OptimizerConfig(2, 60)).optimize(frame).orderBy("pos").collect()
    assert [tuple(r.ticket) for r in got] == greedy(rows, 2, 60)


def test_rounds_and_subsets(spark):
    frame = spark.createDataFrame([(i, sorted(random.Random(i).sample(range(1, 38), 6))) for i in range(3000)], "pos int, ticket array<int>")
    first = frame.groupBy("ticket").agg(F.min("pos").alias("pos"))
    chosen, rounds = first_independent(first, 2)
    assert [tuple(r.ticket) for r in chosen.orderBy("pos").collect()] == greedy([r.ticket for r in frame.orderBy("pos").collect()], 2, 3000)
    assert rounds <= 16
    one = spark.createDataFrame([([1, 4, 6, 9],)], "t array<int>")
    assert one.select(subsets(F.col("t"), 3)).first()[0] == [[1, 4, 6], [1, 4, 9], [1, 6, 9], [4, 6, 9]]
    assert one.select(subsets(F.col("t"), 5)).first()[0] == []


@pytest.mark.parametrize("zeros, size", [(0, 6), (5, 6), (34, 6)])
def test_reservoir_gives_the_tickets_of_the_array(spark, monkeypatch, zeros, size):
    scores = spark.createDataFrame([(i, 0.0 if i <= zeros else 1.0 + i % 7) for i in range(1, 38)], "number int, score double")
    want = TicketGenerator(size).generate_tickets(scores, 90, 42).collect()
    monkeypatch.setattr(sampling, "ARRAY_CANDIDATES", 1)
    monkeypatch.setattr(sampling, "TICKETS_A_ROW", 40)
    got = TicketGenerator(size).generate_tickets(scores.repartition(5), 90, 42).collect()
    assert {r.ticket_no: r.ticket for r in got} == {r.ticket_no: r.ticket for r in want}


def test_reservoir_of_many_candidates(spark):
    """A number of half of the weight stands in about all tickets; none repeats a number; equal seeds, equal tickets."""
    scores = spark.range(1, 20_001).select(F.col("id").cast("int").alias("number"), F.when(F.col("id") == 9, 20_000.0).otherwise(1.0).alias("score"))
    made = TicketGenerator(6, 1, 1 << 30).generate_tickets(scores, 50, 3)
    got = {r.ticket_no: tuple(r.ticket) for r in made.collect()}
    assert sorted(got) == list(range(50)) and all(len(set(t)) == 6 for t in got.values())
    assert sum(9 in t for t in got.values()) >= 45
    again = TicketGenerator(6, 1, 1 << 30).generate_tickets(scores.repartition(3), 50, 3).collect()
    assert {r.ticket_no: tuple(r.ticket) for r in again} == got


def test_requested_tickets(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TICKETS_A_ROW", 3)
    kind = "request_id long, tickets int, main_number_count int, min_number int, max_number int"
    asked = spark.createDataFrame([(1, 7, 6, 1, 37), (2, 1, 3, 5, 7), (3, 6, 1, 2, 2)], kind)
    got = defaultdict(dict)
    for r in RandomBaseline.requested(asked, 5).collect():
        got[r.request_id][r.ticket_no] = r.ticket
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(7)), 2: [0], 3: list(range(6))}
    assert got[2][0] == [5, 6, 7] and set(map(tuple, got[3].values())) == {(2,)}
    assert all(len(set(t)) == 6 and t == sorted(t) and 1 <= t[0] and t[-1] <= 37 for t in got[1].values())
    many = RandomBaseline.requested(spark.createDataFrame([(1, 5000, 2, 1, 4)], kind), 1).collect()
    assert all(abs(n - 5000 / 6) < 130 for n in Counter(tuple(r.ticket) for r in many).values())
    for bad in ((None, 1, 1, 1, 1), (1, 0, 1, 1, 1), (1, 1, 3, 1, 2), (1, 1, 1, 0, 2), (1, None, 1, 1, 2)):
        with pytest.raises(BaselineError):
            RandomBaseline.requested(spark.createDataFrame([(7, 1, 1, 1, 1), bad], kind))
    assert RandomBaseline.requested(asked.filter("false")).count() == 0


def test_recommend_many_tickets_as_rows(spark):
    counts = spark.createDataFrame([(i, 10 + i) for i in range(1, 38)], "number int, count long")
    engine = RecommendationEngine(optimizer=TicketOptimizer(OptimizerConfig(2, 50)))
    made = engine.recommend(counts, 600, 9)
    tickets = [r.ticket for r in made.generated.orderBy("pos").collect()]
    assert len(tickets) == 600 and [r.ticket for r in made.recommended.orderBy("pos").collect()] == [list(t) for t in greedy(tickets, 2, 50)]
