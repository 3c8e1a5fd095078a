import itertools
import random

import pytest
from pyspark.sql import functions as F

from drawloom.functions.arrays import compatible, jaccard_similarity, overlap
from drawloom.operators import diversity
from drawloom.operators.diversity import OptimizerConfig, TicketOptimizer, TicketSelector
from drawloom.operators.draws import DrawDataset
from drawloom.operators.sampling import RandomBaseline, TicketGenerator
from drawloom.operators.scoring import NumberPredictor
from drawloom.operators.stats import number_counts, number_frequency
from drawloom.plans.backtest import Backtester
from drawloom.plans.recommend import RecommendationEngine
from drawloom.schema import BacktestError, GeneratorError, OptimizerError, SelectionError
from test_draws import FIVE, SIX


def counts(spark, d):
    return spark.createDataFrame(list(d.items()), "number int, count long")


def recency(spark, d):
    return spark.createDataFrame(list(d.items()), "number int, recency double")


def scored(spark, d):
    return spark.createDataFrame(list(d.items()), "number int, score double")


def tickets(spark, rows):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(rows)], "pos int, ticket array<int>")


def listed(df):
    return [tuple(r.ticket) for r in df.orderBy(df.columns[0]).collect()]


def test_scores(spark):
    p = NumberPredictor()
    got = {r.number: r.score for r in p.score_numbers(counts(spark, {1: 10, 2: 5, 3: 2})).collect()}
    assert got == pytest.approx({1: 0.7, 2: 0.35, 3: 0.14})
    got = {r.number: r.score for r in p.score_numbers(counts(spark, {1: 10, 2: 5, 3: 2}), recency(spark, {1: 0.5, 2: 1.0, 3: 0.2, 9: 1.0})).collect()}
    assert got == pytest.approx({1: 0.85, 2: 0.65, 3: 0.2})
    assert [r.number for r in p.rank_numbers(counts(spark, {5: 10, 2: 10, 8: 5})).orderBy("rank").collect()] == [2, 5, 8]
    assert p.score_numbers(counts(spark, {1: 0}).filter("false")).count() == 0
    assert p.score_numbers(counts(spark, {1: 0})).first().score == 0
    with pytest.raises(ValueError):
        p.score_numbers(counts(spark, {1: -1}))
    for weights in ((0, 0), (-1, 1), (1, -1)):
        with pytest.raises(ValueError):
            NumberPredictor(*weights)


def test_generator(spark):
    g, s = TicketGenerator(), scored(spark, {i: float(i) for i in range(1, 11)})
    a = listed(g.generate_tickets(s, 20, 42))
    assert len(a) == 20 and all(len(set(t)) == 6 and list(t) == sorted(t) for t in a)
    assert a == listed(g.generate_tickets(s.repartition(7), 20, 42)) != listed(g.generate_tickets(s, 20, 43))
    assert len(listed(g.generate_ticket(s))) == 1
    for bad, error in (({1: 1.0, 2: 1.0, 3: 1.0}, "Not enough"), ({**{i: 1.0 for i in range(1, 7)}, 0: 1.0}, "outside"), ({**{i: 1.0 for i in range(1, 7)}, 7: -1.0}, "negative"), ({**{i: 1.0 for i in range(1, 7)}, 7: float("nan")}, "negative")):
        with pytest.raises(GeneratorError, match=error):
            g.generate_tickets(scored(spark, bad), 1)
    with pytest.raises(GeneratorError, match="Duplicate"):
        g.generate_tickets(s.union(s), 1)
    with pytest.raises(ValueError):
        g.generate_tickets(s, 0)


def test_weighted_sampling_has_the_distribution_of_successive_draws(spark):
    weights, n = {1: 4.0, 2: 2.0, 3: 1.0, 4: 0.0}, 20_000
    got = TicketGenerator(2, 1, 4).generate_tickets(scored(spark, weights), n, 42).select(F.explode("ticket").alias("x")).groupBy("x").count().collect()
    share = {r.x: r["count"] / n for r in got}
    for x in (1, 2, 3):
        exact = sum(weights[a] / 7 * weights[b] / (7 - weights[a]) for a, b in itertools.permutations((1, 2, 3), 2) if x in (a, b))
        assert share[x] == pytest.approx(exact, abs=0.012)
    assert 4 not in share
    last = listed(TicketGenerator(4, 1, 4).generate_tickets(scored(spark, weights), 3, 1))
    assert last == [(1, 2, 3, 4)] * 3
    zeros = TicketGenerator(1, 1, 4).generate_tickets(scored(spark, {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}), 4000, 7).select(F.explode("ticket").alias("x")).groupBy("x").count().collect()
    assert all(abs(r["count"] - 1000) < 130 for r in zeros) and len(zeros) == 4


def test_baseline(spark):
    b = RandomBaseline()
    a = listed(b.generate_tickets(spark, 10, 123))
    assert len(a) == 10 and all(len(set(t)) == 6 and 1 <= min(t) and max(t) <= 37 for t in a)
    assert a == listed(b.generate_tickets(spark, 10, 123)) != listed(b.generate_tickets(spark, 10, 456))
    assert all(len(t) == 3 and max(t) <= 10 for t in listed(RandomBaseline(3, 1, 10).generate_tickets(spark, 5, 1)))
    for bad in ((0, 1, 37), (6, 0, 37), (6, 5, 4), (6, 1, 5)):
        with pytest.raises(ValueError):
            RandomBaseline(*bad)
        with pytest.raises(ValueError):
            TicketGenerator(*bad)
    with pytest.raises(ValueError):
        b.generate_tickets(spark, 0)


def test_pairs_of_tickets(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [4, 5, 6, 7, 8, 9]), ([], []), ([1, 1, 2], [1, 2, 2])], "a array<int>, b array<int>")
    got = df.select(overlap(F.col("a"), F.col("b")).alias("o"), jaccard_similarity(F.col("a"), F.col("b")).alias("j")).collect()
    assert [(r.o, r.j) for r in got] == [(3, 3 / 9), (0, 1.0), (2, 1.0)]
    one = spark.createDataFrame([([1, 2, 3, 4, 7, 8], [[1, 2, 3, 4, 5, 6]]), ([1, 2, 3, 4, 5, 7], [[1, 2, 3, 4, 5, 6]])], "t array<int>, s array<array<int>>")
    assert [r[0] for r in one.select(compatible(F.col("t"), F.col("s"), 4)).collect()] == [True, False]


def test_optimizer(spark):
    six, o = tuple(range(1, 7)), TicketOptimizer()
    assert listed(o.optimize(tickets(spark, [six, six, range(7, 13)]))) == [six, tuple(range(7, 13))]
    assert listed(o.optimize(tickets(spark, [six, (1, 2, 3, 4, 5, 7), range(8, 14)]))) == [six, tuple(range(8, 14))]
    assert len(listed(TicketOptimizer(OptimizerConfig(0, 2)).optimize(tickets(spark, [six, range(7, 13), range(13, 19)])))) == 2
    assert listed(o.optimize(tickets(spark, [(6, 5, 4, 3, 2, 1)]))) == [six]
    for bad, error in (((), "empty"), ((1, 2, 2, 3, 4, 5), r"duplicate numbers: \(1, 2, 2, 3, 4, 5\)")):
        with pytest.raises(OptimizerError, match=error):
            o.optimize(tickets(spark, [six, bad]))
    for bad in ((-1, 1), (1, 0)):
        with pytest.raises(ValueError):
            OptimizerConfig(*bad)
    assert listed(TicketSelector().select(tickets(spark, [six]))) == [six]
    for bad, error in (([], "No tickets were provided"), ([()], "Ticket optimization failed: Ticket cannot be empty")):
        with pytest.raises(SelectionError, match=error):
            TicketSelector().select(tickets(spark, bad))


def test_optimizer_rounds_equal_the_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(diversity, "AHEAD", 1)
    rng = random.Random(4)
    rows = [rng.sample(range(1, 11), 6) for _ in range(150)]
    for most, limit in ((3, 10), (4, 12), (6, 5), (0, 3)):
        want = []
        for t in map(sorted, rows):
            if t not in want and len(want) < limit and all(len(set(t) & set(c)) <= most for c in want):
                want.append(t)
        got = TicketOptimizer(OptimizerConfig(most, limit)).optimize(tickets(spark, rows).repartition(4))
        assert [list(x) for x in listed(got)] == want and [r.pos for r in got.collect()] == list(range(len(want)))


def test_tickets_of_a_call_are_spread_and_equal_those_of_lists(spark):
    g, s = TicketGenerator(), scored(spark, {i: float(i) for i in range(1, 11)})
    spread = g.generate_tickets(s, 500, 42)
    lists = g.generate_lists(s, 500, F.lit(42), []).select(F.posexplode("tickets").alias("n", "ticket"))
    assert spread.rdd.getNumPartitions() > 1 and listed(spread) == listed(lists)


def test_scores_and_frequencies_are_in_the_order_of_numbers(spark):
    c = counts(spark, {9: 3, 2: 5, 30: 1, 4: 9}).repartition(3)
    assert [r.number for r in NumberPredictor().score_numbers(c).collect()] == [2, 4, 9, 30]
    shares = number_frequency(DrawDataset.of(spark, FIVE).draws.repartition(3)).collect()
    assert [r.number for r in shares] == list(range(1, 19))


def test_recommend(spark):
    c = number_counts(DrawDataset.of(spark, FIVE).draws)
    made = RecommendationEngine().recommend(c, 50, 42)
    again = RecommendationEngine().recommend(c, 50, 42)
    assert made.generated.count() == 50 and 0 < made.recommended.count() <= 10 and made.scores.count() == 18
    assert listed(made.recommended) == listed(again.recommended) and set(listed(made.recommended)) <= set(listed(made.generated))
    with pytest.raises(ValueError):
        RecommendationEngine().recommend(c, 0)


def test_backtest(spark):
    d = DrawDataset.of(spark, SIX).draws
    result = Backtester().run(d, 3, 1, 10, 42)
    cases = result.cases.orderBy("ord").collect()
    assert [(c.test_draw_id, c.train_size, c.test_size, c.generated_ticket_count) for c in cases] == [("d", 3, 1, 10), ("e", 4, 1, 10), ("f", 5, 1, 10)]
    assert all(0 <= c.best_match <= 6 and c.best_match <= c.total_matches and c.recommended_ticket_count <= 10 for c in cases)
    s = result.summary().first()
    assert (s.case_count, s.total_matches, s.best_match) == (3, sum(c.total_matches for c in cases), max(c.best_match for c in cases))
    assert s.average_matches == s.total_matches / 3 and result.report().first().total_difference == s.total_matches - s.baseline_total_matches
    assert result.at_least(1).first().match_count == sum(c.best_match >= 1 for c in cases)
    assert [tuple(r) for r in Backtester().run(d, 3, 1, 10, 42).cases.orderBy("ord").collect()] == [tuple(c) for c in cases]
    two = Backtester().run(d, 3, 2, 5, 1).cases.collect()
    assert len(two) == 2 and all(c.train_size == 3 and c.test_size == 2 for c in two)
    assert [tuple(r) for r in result.at_least(1, 9).collect()] == [(1, sum(c.best_match >= 1 for c in cases), sum(c.baseline_best_match >= 1 for c in cases)), (9, 0, 0)]
    with pytest.raises(ValueError):
        result.at_least(0)
    with pytest.raises(BacktestError):
        Backtester().run(d, 6, 1)
    for bad in ((0, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            Backtester().run(d, *bad)
    empty = type(result)(result.cases.filter("false")).summary().first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0, 0, 0.0)
