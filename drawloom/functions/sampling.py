"""Seeded sampling without replacement as column expressions.

A number's key is -ln(u) / weight with u from a hash of (stream, seed, ticket, number);
the numbers with the smallest keys have the distribution of successive weighted draws
(Efraimidis and Spirakis, 2006).  Hashing makes tickets independent of each other and
of the partitioning, so any task can make any ticket.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(stream: str, seed: Column, ticket_no: Column, number: Column) -> Column:
    """A number in (0, 1) that depends on the arguments alone."""
    word = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(stream), seed.cast("string"), ticket_no.cast("string"), number.cast("string")).cast("binary")), 1, 8), 16, 10)
    return (word.cast("double") + 1) / F.lit(4294967297.0)


def weighted_ticket(candidates: Column, seed: Column, ticket_no: Column, count: int, stream: str = "engine") -> Column:
    """``count`` numbers, ascending; candidates: array of struct(number, weight).

    Numbers of no weight come last, in uniform order.
    """

    def race(c: Column) -> Column:
        u = uniform(stream, seed, ticket_no, c["number"])
        return F.struct(F.when(c["weight"] > 0, -F.log(u) / c["weight"]).otherwise(F.lit(float("inf"))).alias("key"), u.alias("u"), c["number"].alias("number"))

    return F.array_sort(F.transform(F.slice(F.array_sort(F.transform(candidates, race)), 1, count), lambda r: r["number"]))


def uniform_ticket(seed: Column, ticket_no: Column, count: int | Column, low: int | Column, high: int | Column, stream: str = "baseline") -> Column:
    """``count`` different numbers of low..high, ascending, all equally likely."""
    count, low, high = (x if isinstance(x, Column) else F.lit(x) for x in (count, low, high))
    race = F.transform(F.sequence(low, high), lambda n: F.struct(uniform(stream, seed, ticket_no, n).alias("u"), n.alias("number")))
    return F.array_sort(F.transform(F.slice(F.array_sort(race), F.lit(1), count), lambda r: r["number"]))
