"""Queries over the driver tables and the SQL that gives the same rows.

Draws come from orders (see sources.tables).  Walk-forward queries train on half of
the draws and test in blocks of a twentieth, with TICKETS tickets and SEED; the draws in
their order are a written table, as counting, checking and testing each read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import distinct_tickets, jaccard_similarity, overlap
from ..operators import draws as D
from ..operators import stats as S
from ..operators.diversity import OptimizerConfig, TicketOptimizer, TicketSelector
from ..operators.sampling import RandomBaseline, TicketGenerator
from ..operators.scoring import NumberPredictor
from ..operators.sketches import day_sketches, over_spans
from ..operators.temporal import as_of, within
from ..sources import tables
from ..sources.csv_draws import CsvDatasetLoader
from ..sources.entries import entries_desc as newest_first
from ..sql import register
from ..storage import fresh_path, written
from .backtest import Backtester, BacktestResult
from .recommend import RecommendationEngine

TICKETS, SEED = 20, 42
#: Tickets of the query that recommends many.
MANY = 2000


def listed(ticket: Column) -> Column:
    """A ticket as text."""
    return F.array_join(ticket.cast("array<string>"), ",")


def _sizes(draws: DataFrame) -> tuple[int, int, int]:
    """Training size, test size and number of draws."""
    n = draws.count()
    return max(n // 2, 1), max(n // 20, 1), n


def _walk(spark: SparkSession, sf_dir: str) -> D.WalkForward:
    draws = tables.draws(spark, sf_dir)
    return D.WalkForward(draws, *_sizes(draws))


def _each_draw(spark: SparkSession, sf_dir: str) -> D.WalkForward:
    """Splits that train on half of the draws or more and test on one draw each."""
    draws = tables.draws(spark, sf_dir)
    train, _, n = _sizes(draws)
    return D.WalkForward(draws, train, 1, n)


def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dataset_statistics(tables.numbers_only(spark, sf_dir))


def lottery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lottery_summary(tables.numbers_only(spark, sf_dir))


def number_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.number_frequency(tables.numbers_only(spark, sf_dir))


def frequency_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frequency_for(number_frequency(spark, sf_dir), 7)


def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_frequent(number_frequency(spark, sf_dir), 10)


def least_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.least_frequent(number_frequency(spark, sf_dir), 10)


def _shown(draws: DataFrame) -> DataFrame:
    return draws.select("ord", "draw_id", listed(F.col("numbers")).alias("numbers"), "date")


def draws_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tables.draws(spark, sf_dir))


def draw_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(tables.draws(spark, sf_dir).filter("ord = 100"))


def latest_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.latest_draw(tables.draws(spark, sf_dir)))


def append_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.range(1).select(F.lit(0).cast("long").alias("ord"), F.lit("new").alias("draw_id"), F.array(*(F.lit(i) for i in range(1, 7))).alias("numbers"), F.lit(None).cast("string").alias("date"))
    return _shown(D.append_draw(tables.draws(spark, sf_dir), one))


def draw_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of which five in seven are broken on purpose, each in its way."""
    k = F.col("draw_id").cast("long") % 7
    broken = tables.numbers_only(spark, sf_dir).select(
        F.col("draw_id").alias("key"), F.when(k == 1, F.lit("")).otherwise(F.col("draw_id")).alias("draw_id"),
        F.when(k == 2, F.array().cast("array<int>")).when(k == 3, F.concat("numbers", F.slice("numbers", 1, 1))).when(k == 4, F.concat("numbers", F.array(F.lit(0)))).when(k == 5, F.concat("numbers", F.array(F.lit(None).cast("int")))).otherwise(F.col("numbers")).alias("numbers"),
    )
    return broken.select("key", F.coalesce(D.draw_error(), F.lit("valid")).alias("verdict"))


def frequency_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by number, year and month together, by number and year, by number, by year, and in all; 0 stands for all."""
    sets = [["number", "year", "month"], ["number", "year"], ["number"], ["year"], []]
    return S.frequency_cube(tables.draws(spark, sf_dir), sets).fillna(0)


def pair_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pair_cube(tables.draws(spark, sf_dir)).fillna(0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, at (microseconds): the events, their January of 2024 stretched by 80 to the years of the draws from 1995 on."""
    since = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    return tables.read(spark, sf_dir, "events").select("event_id", (since * 80 + 788_918_400_000_000).alias("at"))


def latest_draw_before_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest draw of the day of each event or before it; position -1 where there was none."""
    draws = tables.draws(spark, sf_dir).select("ord", "draw_id", F.unix_micros(F.to_timestamp("date")).alias("since"))
    joined = as_of(_events(spark, sf_dir), draws, at="at", since="since", ties=["ord"])
    return joined.select("event_id", F.coalesce("latest.ord", F.lit(-1)).alias("ord"), F.coalesce("latest.draw_id", F.lit("")).alias("draw_id"))


def events_in_test_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the time that each split tests, from the day of its first draw to the end of the day of its last one."""
    day = F.unix_micros(F.to_timestamp("date"))
    spans = _walk(spark, sf_dir).test_rows().groupBy("split_id").agg(F.min(day).alias("begin"), (F.max(day) + 86_400_000_000 - 1).alias("end"))
    return within(_events(spark, sf_dir), spans, at="at", begin="begin", end="end").select("split_id", "event_id")


def _recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recency of our own: (number mod 5) / 4 for numbers not divisible by 3."""
    return S.number_counts(tables.numbers_only(spark, sf_dir)).filter("number % 3 <> 0").select("number", (F.col("number") % 5 / F.lit(4.0)).alias("recency"))


def score_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NumberPredictor().score_numbers(S.number_counts(tables.numbers_only(spark, sf_dir)))


def score_with_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NumberPredictor().score_numbers(S.number_counts(tables.numbers_only(spark, sf_dir)), _recency(spark, sf_dir))


def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of all numbers of all draws; -1 where a number is seen for the first time."""
    return S.number_gaps(tables.draws(spark, sf_dir)).fillna(-1, ["gap"])


def gap_recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores whose recency comes from the draws: how long ago each number was last seen."""
    draws = tables.draws(spark, sf_dir)
    recency = S.number_recency(draws)
    return NumberPredictor().score_numbers(S.number_counts(draws), recency).join(recency.select("number", "gap"), "number")


def rank_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NumberPredictor().rank_numbers(S.number_counts(tables.numbers_only(spark, sf_dir)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each draw beside the one before it."""
    d = tables.draws(spark, sf_dir).select("ord", "numbers")
    return d.join(d.select((F.col("ord") + 1).alias("ord"), F.col("numbers").alias("other")), "ord")


def ticket_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("ord", overlap(F.col("numbers"), F.col("other")).cast("long").alias("overlap"))


def ticket_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("ord", jaccard_similarity(F.col("numbers"), F.col("other")).alias("jaccard"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws as tickets in lists of 40 by position."""
    d = tables.draws(spark, sf_dir).select(F.expr("ord div 40").alias("list"), (F.col("ord") % 40).alias("pos"), "numbers")
    return d.groupBy("list").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "numbers"))), lambda x: x["numbers"]).alias("tickets"))


def _exploded(lists: DataFrame, column: Column) -> DataFrame:
    return lists.select("list", F.posexplode(column).alias("pos", "_t")).select("list", F.col("pos").cast("long").alias("pos"), listed(F.col("_t")).alias("ticket"))


def distinct_ticket_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_lists(spark, sf_dir), distinct_tickets(F.col("tickets")))


def optimize_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(TicketOptimizer().optimize_lists(_lists(spark, sf_dir)), F.col("recommended"))


def select_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selector's choice from all draws as one list of tickets, in their order."""
    draws = tables.draws(spark, sf_dir)
    chosen = TicketSelector().select(draws.select(F.col("ord").alias("pos"), F.col("numbers").alias("ticket")))
    return chosen.select(F.col("pos").cast("long").alias("pos"), listed(F.col("ticket")).alias("ticket"))


def diverse_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws as one list of tickets, of which each may share two numbers with any accepted before it; no bound that is met."""
    draws = tables.draws(spark, sf_dir).select(F.col("ord").alias("pos"), F.col("numbers").alias("ticket"))
    chosen = TicketOptimizer(OptimizerConfig(max_overlap=2, max_tickets=100_000)).optimize(draws)
    return chosen.select(F.col("pos").cast("long").alias("pos"), listed(F.col("ticket")).alias("ticket"))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the CSV loader makes of a record for each order, of which some are broken on purpose, each in its way.

    The records are made here as the reader gives them, from the line numbers of orders
    as texts with blanks, signs, semicolons and empty parts.
    """
    k = F.col("o_orderkey")
    key, part = k.cast("string"), lambda m: (k % m + 1).cast("string")
    three = F.concat(part(7), F.lit(", "), (k % 5 + 11).cast("string"), F.lit(";;+"), (k % 3 + 31).cast("string"), F.lit(" "))
    text = (
        F.when(k % 11 == 1, F.lit("  ")).when(k % 11 == 2, F.lit("1,x,3")).when(k % 11 == 3, F.lit(" ; ,"))
        .when(k % 11 == 4, F.concat(part(7), F.lit(","), part(7))).when(k % 11 == 5, F.lit("4,0")).otherwise(three)
    )
    name = F.when(k % 11 == 6, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), key))
    date = F.when(k % 2 == 0, F.lit(" ")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    raw = tables.read(spark, sf_dir, "orders").select(name.alias("_c0"), text.alias("_c1"), date.alias("_c2"), (k + 1).alias("_id"))
    rows = CsvDatasetLoader().rows(raw, ["draw_id", "numbers", "date"])
    return rows.select("ord", "draw_id", listed(F.col("numbers")).alias("numbers"), "date", "error")


def csv_file_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws written as CSV files, some with line breaks between their numbers, and loaded from them by many tasks."""
    draws, path = tables.draws(spark, sf_dir), fresh_path(spark, "draws-csv")
    texts = F.col("numbers").cast("array<string>")
    numbers = F.when(F.col("ord") % 5 == 0, F.array_join(texts, ",\n")).otherwise(F.array_join(texts, "; "))
    lined = draws.repartitionByRange("ord").sortWithinPartitions("ord")
    lined.select("date", numbers.alias("numbers"), "draw_id").write.option("header", True).option("escape", '"').csv(path)
    return _shown(CsvDatasetLoader(split=True).load(spark, path).draws)


def walk_forward_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = _walk(spark, sf_dir)
    return walk.test_rows().join(walk.splits(), "split_id").select("split_id", "train_size", "test_size", "ord", "draw_id")


def sql_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split the test draws, their numbers and the lowest and highest position, from SQL."""
    draws = tables.draws(spark, sf_dir)
    train, test, n = _sizes(draws)
    register(spark, draws)
    return spark.sql(f"""SELECT split_id, split_train_size AS train_size, count(*) AS draws, sum(size(numbers)) AS numbers, min(ord) AS first_ord, max(ord) AS last_ord
        FROM walk_forward(TABLE(draws), {train}, {test}, {n}) GROUP BY split_id, split_train_size""")


def walk_forward_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir).train_frequency()


def walk_forward_each_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, gaps and scores of the numbers before every draw of the second half, each a split of its own."""
    told = _each_draw(spark, sf_dir).train_recency()
    return NumberPredictor().with_scores(told, ["split_id"], "recency").select("split_id", "number", "count", "gap", "score")


def generate_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = NumberPredictor().score_numbers(S.number_counts(tables.numbers_only(spark, sf_dir)))
    return TicketGenerator().generate_tickets(scores, TICKETS, SEED).select(F.col("ticket_no").cast("long").alias("ticket_no"), listed(F.col("ticket")).alias("ticket"))


def reservoir_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of six parts (keys from 1), weighted by their prices; the parts are rows all the way."""
    parts = tables.read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("number"), F.col("p_retailprice").cast("double").alias("score"))
    generator = TicketGenerator(6, 1, (1 << 31) - 1)
    made = generator.generate_tickets(parts, TICKETS, SEED)
    return made.select(F.col("ticket_no").cast("long").alias("ticket_no"), listed(F.col("ticket")).alias("ticket"))


def baseline_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suppliers ask for: one to three tickets of six numbers, from ranges that begin and end where their keys say."""
    key = F.col("s_suppkey").cast("int")
    requests = tables.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"), (key % 3 + 1).alias("tickets"), F.lit(6).alias("main_number_count"),
        (key % 4 + 1).alias("min_number"), (key % 11 + 37).alias("max_number"),
    )
    made = RandomBaseline.requested(requests, SEED)
    return made.select("request_id", F.col("ticket_no").cast("long").alias("ticket_no"), listed(F.col("ticket")).alias("ticket"))


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = RecommendationEngine().recommend(S.number_counts(tables.numbers_only(spark, sf_dir)), TICKETS, SEED)
    return made.recommended.select(F.col("pos").cast("long").alias("pos"), listed(F.col("ticket")).alias("ticket"))


def recommend_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 500 tickets out of 2,000 that share three numbers at most."""
    engine = RecommendationEngine(optimizer=TicketOptimizer(OptimizerConfig(max_overlap=3, max_tickets=500)))
    made = engine.recommend(S.number_counts(tables.numbers_only(spark, sf_dir)), MANY, SEED)
    return made.recommended.select(F.col("pos").cast("long").alias("pos"), listed(F.col("ticket")).alias("ticket"))


def backtest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk = _walk(spark, sf_dir)
    tickets = Backtester().split_tickets(walk, TICKETS, SEED).select("split_id", F.posexplode("recommended").alias("pos", "ticket"))
    return walk.test_rows().join(tickets, "split_id").select("split_id", "ord", F.col("pos").cast("long").alias("pos"), overlap(F.col("ticket"), F.col("numbers")).cast("long").alias("matches"))


def _result(spark: SparkSession, sf_dir: str) -> BacktestResult:
    draws = tables.draws(spark, sf_dir)
    train, test, n = _sizes(draws)
    return Backtester().run(draws, train, test, TICKETS, SEED, n=n)


def backtest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).cases


def backtest_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that match three numbers at least, stored as semi-structured values, chosen and read by path."""
    stored = spark.read.parquet(written(_result(spark, sf_dir).variants(), "case-variants"))
    good = stored.filter(F.variant_get("result", "$.matches[0].best", "int") >= 3)
    return BacktestResult.from_variants(good).cases


def span_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the time that each split tests, from merged sketches of days: n, and whether estimates hold their bounds.

    Bounds: customers to 6 %, ranks of the quartiles of prices to 0.04 of the orders, the priorities' counts exact.
    """
    orders = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    spans = _walk(spark, sf_dir).test_rows().groupBy("split_id").agg(F.to_date(F.min("date")).alias("first_day"), F.to_date(F.max("date")).alias("last_day"))
    spans = spans.withColumnRenamed("split_id", "span_id")
    sketches = day_sketches(orders, day="day", distinct="o_custkey", value="o_totalprice", item="o_orderpriority")
    told = over_spans(sketches, spans, quantiles=[0.25, 0.5, 0.75])
    days = lambda c: F.unix_date(c).cast("long")
    numbered = spans.select("span_id", days("first_day").alias("a"), days("last_day").alias("b"))
    met = within(orders.withColumn("at", days("day")), numbered, at="at", begin="a", end="b").join(told, "span_id")
    rank = lambda i: F.sum((F.col("o_totalprice") <= F.col("quantiles")[i]).cast("int")) / F.count(F.lit(1))
    near = [F.abs(rank(i) - q) <= 0.04 for i, q in enumerate((0.25, 0.5, 0.75))]
    most = F.sum((F.col("o_orderpriority") == F.col("top")[0]["item"]).cast("int")) == F.first(F.col("top")[0]["count"])
    customers = F.count_distinct("o_custkey")
    checked = met.groupBy("span_id").agg(F.first("n").alias("n"), (F.abs(F.first("distinct") - customers) <= 0.06 * customers).alias("distinct_near"), (near[0] & near[1] & near[2]).alias("quartiles_near"), most.alias("top_exact"))
    return checked


def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).summary()


def match_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).at_least(*range(1, 7))


def backtest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).report()


def backtest_each_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest with a split for each draw of the second half; what its cases sum up to."""
    walk = _each_draw(spark, sf_dir)
    return Backtester().run(walk.draws, walk.train_size, 1, TICKETS, SEED, n=walk.n).report()


def entries_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_first(tables.entries(spark, sf_dir))


def entry_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.entries(spark, sf_dir).filter("id = 17")


QUERIES = (
    dataset_statistics, lottery_summary, number_frequency, frequency_for, most_frequent, least_frequent, draws_in_order,
    draw_at, latest_draw, append_draw, draw_validation, score_numbers, score_with_recency, number_gaps, gap_recency_scores,
    rank_numbers, frequency_cube, pair_cube, latest_draw_before_events, events_in_test_spans, ticket_overlap, ticket_jaccard, distinct_ticket_lists, optimize_tickets, select_tickets, diverse_draws,
    csv_rows, csv_file_draws, walk_forward_splits, sql_walk_forward, walk_forward_frequency, walk_forward_each_draw, generate_tickets, reservoir_tickets,
    baseline_tickets, recommend, recommend_many, backtest_matches, backtest_cases, backtest_variants, span_sketches, backtest_summary, match_thresholds,
    backtest_report, backtest_each_draw, entries_desc, entry_by_id,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
