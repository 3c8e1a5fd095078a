"""Tickets by seeded sampling: weighted ones and the uniform baseline."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.batches import uniform_tickets, weighted_tickets
from ..functions.sampling import uniform, uniform_ticket, weighted_ticket
from ..schema import BaselineError, GeneratorError
from ..storage import materialize


#: Numbers up to which the candidates of a ticket are one array.
ARRAY_CANDIDATES = 1_000
#: Tickets that one row of the reservoir makes.
TICKETS_A_ROW = 1_000


def _check_range(main: int, low: int, high: int) -> None:
    """A ticket of ``main`` different numbers needs so many between ``low`` and ``high``, all over 0."""
    least = {"main_number_count": (main, 1), "min_number": (low, 1), "max_number": (high, low + main - 1)}
    for name, (value, bound) in least.items():
        if value < bound:
            raise ValueError(f"{name} must be at least {bound}, not {value}")


def fixed_seed(seed: int | None) -> int:
    """The seed, or a fresh one drawn on the driver once."""
    return random.SystemRandom().randrange(1 << 31) if seed is None else seed


def reservoir(candidates: DataFrame, count: int, size: int, seed: int) -> DataFrame:
    """(ticket_no, ticket): weighted tickets whose candidates (number, score >= 0) stay rows, so there may be any number of them.

    A ticket is the ``size`` numbers of the smallest keys, as in ``weighted_ticket``, and
    the same for the same seed.  Every candidate makes its keys for all tickets where it
    lies; only keys below a bound go on, some tens a ticket, and meet by ticket.  The
    bound is the one that ``size`` + 6 sqrt(size) + 6 keys a ticket are expected under;
    if a ticket yet has too few, all are made again with twice as many.  Candidates
    without weight fill up where fewer than ``size`` have one.
    """
    weighted = candidates.filter("score > 0")
    positive = weighted.count()
    raced = smallest(weighted, count, min(size, positive), seed, weighed=True)
    if positive < size:
        raced = raced.union(smallest(candidates.filter("score = 0"), count, size - positive, seed, weighed=False))
    return raced.groupBy("ticket_no").agg(F.array_sort(F.collect_list("number")).alias("ticket"))


def smallest(candidates: DataFrame, count: int, size: int, seed: int, *, weighed: bool) -> DataFrame:
    """(ticket_no, number): of each ticket the ``size`` candidates of smallest keys, by ticket.

    Keys: -ln(u) / score, or u itself; u is the number from 0 to 1 that a hash of the
    seed, the ticket and the candidate gives.
    """
    if size <= 0:
        return candidates.select(F.lit(0).alias("ticket_no"), "number").filter("false")
    mass = candidates.agg(F.sum("score") if weighed else F.count(F.lit(1)).cast("double")).first()[0]
    rows = -(-count // TICKETS_A_ROW)
    spread = candidates.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    upper = F.least(F.lit(count), (F.col("_r") + 1) * TICKETS_A_ROW) - 1
    made = spread.select("number", "score", F.explode(F.sequence(F.col("_r") * TICKETS_A_ROW, upper)).alias("ticket_no"))
    made = made.withColumn("_u", uniform("engine", F.lit(seed), F.col("ticket_no"), F.col("number")))
    made = made.withColumn("_key", -F.log("_u") / F.col("score") if weighed else F.col("_u"))
    expected = size + 6 * size**0.5 + 6
    while True:
        near = made.filter(F.col("_key") <= F.lit(expected / mass))
        met = near.groupBy("ticket_no").agg(F.array_sort(F.collect_list(F.struct("_key", "_u", "number"))).alias("_all"))
        met = materialize(met.filter(F.size("_all") >= size), "reservoir")
        if met.count() == count:
            return met.select("ticket_no", F.explode(F.slice("_all", 1, size)["number"]).alias("number"))
        expected *= 2


@dataclass(frozen=True)
class TicketGenerator:
    """Weighted tickets without replacement."""

    main_number_count: int = 6
    min_number: int = 1
    max_number: int = 37

    def __post_init__(self) -> None:
        _check_range(self.main_number_count, self.min_number, self.max_number)

    def check_scores(self, scores: DataFrame, by: list[str]) -> None:
        """Raise for scores that can't give a ticket; one aggregate over all splits."""
        n = F.col("number")
        per = scores.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("d"), F.min(F.when((n < self.min_number) | (n > self.max_number), n)).alias("outside"),
            F.min(F.when((F.col("score") < 0) | F.isnan("score") | F.col("score").isNull(), F.coalesce("score", F.lit(float("nan"))))).alias("bad"),
        )
        worst = per.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("n"), F.min("outside").alias("outside"), F.min("bad").alias("bad"), F.max(F.col("n") - F.col("d")).alias("twice")).first()
        self._raise(worst)

    def _raise(self, worst: Row) -> None:
        """The error of the worst lists of candidates, by the first rule that is broken."""
        if not worst.groups or worst.n < self.main_number_count:
            raise GeneratorError("Not enough scored numbers to generate a ticket")
        if worst.outside is not None:
            raise GeneratorError(f"Number {worst.outside} is outside the valid range")
        if worst.bad is not None:
            raise GeneratorError(f"Score cannot be negative: {worst.bad}")
        if worst.twice:
            raise GeneratorError("Duplicate candidate numbers are not allowed")

    def check_lists(self, lists: DataFrame, candidates: Column) -> None:
        """``check_scores`` for arrays of (number, weight), one a row."""
        number, weight = candidates["number"], candidates["weight"]
        low, high = F.array_min(number), F.array_max(number)
        above = F.array_min(F.filter(number, lambda n: n > self.max_number))
        broken = F.isnan(F.array_max(weight)) | (F.size(F.array_compact(weight)) < F.size(weight))
        worst = lists.select(
            F.size(number).alias("n"), F.when(low < self.min_number, low).when(high > self.max_number, above).alias("outside"),
            F.when(F.array_min(weight) < 0, F.array_min(weight)).when(broken, F.lit(float("nan"))).alias("bad"), (F.size(number) - F.size(F.array_distinct(number))).alias("twice"),
        ).agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("n"), F.min("outside").alias("outside"), F.min("bad").alias("bad"), F.max("twice").alias("twice")).first()
        self._raise(worst)

    def generate_lists(self, scores: DataFrame, count: int, seed: Column, by: list[str]) -> DataFrame:
        """(by..., tickets): all tickets of a split as one array; seed may use the columns of ``by``."""
        if count <= 0:
            raise ValueError("count must be positive")
        lists = scores.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("number", F.col("score").alias("weight")))).alias("_c"))
        if by:
            # The lists are few bytes and much work: dealt out evenly, to as many tasks as asked for, whatever their size.
            lists = lists.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return lists.select(*by, weighted_tickets(F.col("_c"), seed, count, self.main_number_count).alias("tickets"))

    def generate_tickets(self, scores: DataFrame, count: int, seed: int | None = None) -> DataFrame:
        """(ticket_no, ticket): ``count`` tickets; equal seeds give equal tickets; tickets may repeat.

        Up to ARRAY_CANDIDATES numbers in the range, the candidates are one array, which
        goes to all tasks, and the tickets are spread over the cluster by their numbers.
        Beyond that the candidates stay rows (``reservoir``); the tickets are the same.
        """
        if count <= 0:
            raise ValueError("count must be positive")
        self.check_scores(scores, [])
        if self.max_number - self.min_number >= ARRAY_CANDIDATES:
            return reservoir(scores, count, self.main_number_count, fixed_seed(seed))
        one = scores.agg(F.sort_array(F.collect_list(F.struct("number", F.col("score").alias("weight")))).alias("_c"))
        t = F.col("id").cast("int")
        numbered = scores.sparkSession.range(count).join(F.broadcast(one))
        ticket = weighted_ticket(F.col("_c"), F.lit(fixed_seed(seed)), t, self.main_number_count)
        return numbered.select(t.alias("ticket_no"), ticket.alias("ticket"))

    def generate_ticket(self, scores: DataFrame, seed: int | None = None) -> DataFrame:
        return self.generate_tickets(scores, 1, seed)


@dataclass(frozen=True)
class RandomBaseline:
    """Uniform tickets."""

    main_number_count: int = 6
    min_number: int = 1
    max_number: int = 37

    def __post_init__(self) -> None:
        _check_range(self.main_number_count, self.min_number, self.max_number)

    def ticket_list(self, count: Column, seed: Column) -> Column:
        """An array of ``count`` tickets, empty for 0."""
        return uniform_tickets(seed, count, self.main_number_count, self.min_number, self.max_number)

    def generate_tickets(self, spark, count: int, seed: int | None = None) -> DataFrame:
        """(ticket_no, ticket): spread over the cluster by ticket."""
        if count <= 0:
            raise ValueError("count must be positive")
        t = F.col("id").cast("int")
        return spark.range(count).select(t.alias("ticket_no"), uniform_ticket(F.lit(fixed_seed(seed)), t, self.main_number_count, self.min_number, self.max_number).alias("ticket"))

    def generate_ticket(self, spark, seed: int | None = None) -> DataFrame:
        return self.generate_tickets(spark, 1, seed)

    @staticmethod
    def requested(requests: DataFrame, seed: int | None = None) -> DataFrame:
        """(request_id, ticket_no, ticket): the tickets that a table asks for.

        ``requests``: (request_id, tickets, main_number_count, min_number, max_number), a
        row for each request with a range of its own.  A request for no tickets, or one
        with a null or a range that can't fill a ticket, is a BaselineError, found in
        one pass before.  Tickets depend on the seed, the request and their number in it,
        which counts from 0; requests that share an id get the same tickets.
        """
        count, low, high, main = (F.col(c) for c in ("tickets", "min_number", "max_number", "main_number_count"))
        sound = F.coalesce((count > 0) & (main > 0) & (low > 0) & (high - low + 1 >= main) & F.col("request_id").isNotNull(), F.lit(False))
        bad = requests.filter(~sound).agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first")).first()
        if bad.n:
            raise BaselineError(f"{bad.n} requests can't be drawn, the first of them {bad.first}")
        rows = requests.withColumn("_r", F.explode(F.expr(f"sequence(0, cast((tickets - 1) div {TICKETS_A_ROW} as int))")))
        upper = F.least(count, (F.col("_r") + 1) * TICKETS_A_ROW).cast("int") - 1
        each = rows.withColumn("ticket_no", F.explode(F.sequence(F.col("_r") * TICKETS_A_ROW, upper)))
        own = F.concat_ws("/", F.lit(str(fixed_seed(seed))), F.col("request_id").cast("string"))
        return each.select("request_id", "ticket_no", uniform_ticket(own, F.col("ticket_no"), main, low, high).alias("ticket"))
