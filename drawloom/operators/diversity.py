"""A diverse subset of tickets by a sequential greedy rule."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import ticket_error
from ..functions.batches import diverse_tickets
from ..schema import OptimizerError, SelectionError
from ..storage import materialize
from .running import ranked


#: Positions that are looked at first, for each ticket that is wanted.
AHEAD = 16
#: Wanted tickets up to which the accepted ones are numbered in one task.
SHORT = 1_000


def subsets(ticket: Column, size: int) -> Column:
    """All subsets of ``size`` elements of an ascending array, ascending."""
    grown = F.transform(ticket, lambda x: F.array(x))
    for _ in range(size - 1):
        longer = lambda s: F.transform(F.filter(ticket, lambda x: x > F.element_at(s, -1)), lambda x: F.array_append(s, x))
        grown = F.flatten(F.transform(grown, longer))
    return grown


def first_independent(tickets: DataFrame, max_overlap: int, before: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((pos, ticket) of the tickets that the sequential rule accepts, rounds); tickets: (pos, ticket), different and ascending.

    Two tickets conflict if they share more than ``max_overlap`` numbers, so if a subset
    of one more number lies in both.  No pairs are made: a subset knows the first
    undecided ticket that holds it.  A ticket that is the first of all its subsets has
    no conflict before it and is accepted, and a ticket with a subset of such a one is
    rejected; the others go to the next round.  So it is the lexicographically first
    independent set, in rounds that grow with the logarithm of the number of tickets
    where their order is arbitrary.  ``before``: tickets that are accepted already.
    """
    keyed = tickets.select("pos", F.explode(subsets(F.col("ticket"), max_overlap + 1)).alias("_key"))
    small = tickets.filter(F.size("ticket") <= max_overlap).select("pos")
    if before is not None:
        taken = before.select(F.explode(subsets(F.col("ticket"), max_overlap + 1)).alias("_key")).distinct()
        beaten = keyed.join(taken, "_key", "left_semi").select("pos").distinct()
        keyed = keyed.join(beaten, "pos", "left_anti")
    accepted, rounds = [small], 0
    left = materialize(keyed, "tickets-subsets-0")
    while not left.isEmpty():
        rounds += 1
        least = left.groupBy("_key").agg(F.min("pos").alias("_first"))
        met = materialize(left.join(least, "_key"), f"tickets-met-{rounds}")
        won = met.groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("_first")).alias("_all")).filter("_all").select("pos")
        decided = met.join(won.withColumnRenamed("pos", "_first"), "_first", "left_semi").select("pos").distinct()
        left = materialize(met.join(decided, "pos", "left_anti").select("pos", "_key"), f"tickets-subsets-{rounds}")
        accepted.append(won)
    chosen = functools.reduce(DataFrame.union, accepted)
    return tickets.join(chosen, "pos", "left_semi").select("pos", "ticket"), rounds


@dataclass(frozen=True)
class OptimizerConfig:
    max_overlap: int = 4
    max_tickets: int = 10

    def __post_init__(self) -> None:
        if self.max_overlap < 0:
            raise ValueError("max_overlap cannot be negative")
        if self.max_tickets <= 0:
            raise ValueError("max_tickets must be positive")


@dataclass(frozen=True)
class TicketOptimizer:
    config: OptimizerConfig = field(default_factory=OptimizerConfig)

    def check(self, tickets: DataFrame) -> None:
        """Raise for the first ticket, by pos, that is empty or repeats a number."""
        bad = tickets.select("pos", ticket_error(F.col("ticket")).alias("e")).filter("e is not null").agg(F.min_by("e", "pos").alias("e")).first()
        if bad.e is not None:
            raise OptimizerError(bad.e)

    def optimize(self, tickets: DataFrame) -> DataFrame:
        """(pos, ticket) of the accepted ones, pos from 0; tickets: (pos, ticket), one list of different pos, checked whole before.

        The sequential rule, in parallel: equal tickets meet in an aggregate, the first of
        them stays; then stretches of positions, each twice as long as all before, until
        there are ``max_tickets``; a stretch leaves out what conflicts with the tickets
        accepted before it, and is decided by ``first_independent``.
        """
        self.check(tickets)
        each = tickets.groupBy(F.array_sort("ticket").alias("ticket")).agg(F.min(F.col("pos").cast("long")).alias("pos"))
        each = materialize(each, "tickets")
        low, end = each.agg(F.min("pos"), F.max("pos") + 1).first()
        accepted, wanted, start = None, self.config.max_tickets, low
        while low is not None and low < end:
            high = min(end, low + AHEAD * wanted + 2 * (low - start))
            stretch = each.filter((F.col("pos") >= low) & (F.col("pos") < high))
            more = first_independent(stretch, self.config.max_overlap, accepted)[0]
            accepted = materialize(more if accepted is None else accepted.unionByName(more), "tickets-accepted")
            low = high
            if low < end and accepted.count() >= wanted:
                break
        accepted = each if accepted is None else accepted
        if wanted <= SHORT:
            first = accepted.orderBy("pos").limit(wanted)
            placed = first.withColumn("_place", F.row_number().over(Window.orderBy("pos")) - 1)
        else:
            placed = ranked(accepted, F.col("pos"), name="_place").filter(F.col("_place") < wanted)
        kind = tickets.schema["ticket"].dataType.simpleString()
        return placed.select(F.col("_place").cast("int").alias("pos"), F.col("ticket").cast(kind).alias("ticket"))

    def optimize_lists(self, lists: DataFrame) -> DataFrame:
        """``lists`` plus recommended; lists: one array ``tickets`` in each row."""
        return lists.withColumn("recommended", diverse_tickets(F.col("tickets"), self.config.max_overlap, self.config.max_tickets))


@dataclass(frozen=True)
class TicketSelector:
    optimizer: TicketOptimizer = field(default_factory=TicketOptimizer)

    def select(self, tickets: DataFrame) -> DataFrame:
        """The optimizer's choice, with selection errors."""
        if tickets.isEmpty():
            raise SelectionError("No tickets were provided")
        try:
            chosen = self.optimizer.optimize(tickets)
        except OptimizerError as bad:
            raise SelectionError(f"Ticket optimization failed: {bad}") from bad
        if chosen.isEmpty():
            raise SelectionError("No tickets remained after optimization")
        return chosen
