"""Column functions on tickets (arrays of numbers) and on lists of tickets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """Number of different elements that both arrays hold."""
    return F.size(F.array_intersect(a, b))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Shared share of the different elements; two empty arrays are alike (1.0)."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(overlap(a, b) / F.greatest(every, F.lit(1)))


def sorted_tickets(tickets: Column) -> Column:
    """Each ticket ascending, the list in its order."""
    return F.transform(tickets, lambda t: F.array_sort(t))


def distinct_tickets(tickets: Column) -> Column:
    """The first of equal tickets stays, in the order of the list."""
    return F.array_distinct(sorted_tickets(tickets))


def compatible(ticket: Column, selected: Column, max_overlap: int) -> Column:
    """No selected ticket shares more than ``max_overlap`` numbers with this one."""
    return ~F.exists(selected, lambda s: overlap(s, ticket) > max_overlap)


def greedy_diverse(tickets: Column, max_overlap: int, max_tickets: int) -> Column:
    """In the order of the list, accept a ticket while there is room and it is compatible with all accepted ones."""
    empty = F.array().cast("array<array<int>>")
    return F.aggregate(distinct_tickets(tickets), empty, lambda acc, t: F.when((F.size(acc) < max_tickets) & compatible(t, acc, max_overlap), F.array_append(acc, t)).otherwise(acc))


def ticket_error(ticket: Column) -> Column:
    """Why a ticket can't be optimized; null if it can."""
    text = F.concat(F.lit("("), F.array_join(F.array_sort(ticket).cast("array<string>"), ", "), F.lit(")"))
    return F.when(F.size(ticket) == 0, F.lit("Ticket cannot be empty")).when(F.size(F.array_distinct(ticket)) != F.size(ticket), F.concat(F.lit("Ticket contains duplicate numbers: "), text))
