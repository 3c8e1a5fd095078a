"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Links are given by a group column: documents of a group are neighbours of each
other through a hub, so no pairs are built.  Each round moves groups to their
favourite shard with room as far as the shard's quota allows, until none moves.  A last step cuts the line of
all documents, ordered by shard and group, into equal parts, so the sizes are exactly
even and at most one group is cut at each border.  DataFrame operations only; the
driver holds one row a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize
from .mixing import PLACES, mark, placed
from .order import ranked


#: Buckets of the groups of one size class that wish for one shard, which are admitted or not as a whole.
BUCKETS = 256
#: Rounds in a row without a move after which groups that hinder each other stay cut.
IDLE = 3


def admitted(cells: DataFrame, room: Column) -> DataFrame:
    """(_to, _left, _in: array of (c, b), _most): what each shard takes of its cells (_to, _class, _bucket, _n, _groups).

    A fold over a shard's cells, the largest classes first, takes each that still fits
    into ``room[_to]``; ``c`` is the class with its sign turned.  One row a shard, whose
    arrays have at most BUCKETS entries a size class.
    """
    cell = F.struct((-F.col("_class")).alias("c"), F.col("_bucket").alias("b"), F.col("_n").alias("n"))
    listed = cells.groupBy("_to").agg(F.array_sort(F.collect_list(cell)).alias("_cells"), F.max("_groups").alias("_most"))
    start = F.struct(F.get(room, F.col("_to")).alias("left"), F.expr("cast(array() as array<struct<c:int,b:int>>)").alias("in"))

    def take(state: Column, e: Column) -> Column:
        more = F.array_append(state["in"], F.struct(e["c"].alias("c"), e["b"].alias("b")))
        return F.when(e["n"] <= state["left"], F.struct((state["left"] - e["n"]).alias("left"), more.alias("in"))).otherwise(state)

    return listed.withColumn("_state", F.aggregate("_cells", start, take)).select(
        "_to", F.col("_state.left").alias("_left"), F.col("_state.in").alias("_in"), "_most"
    )


def propagate(groups: DataFrame, total: int, shards: int, rounds: int | None, slack: float) -> DataFrame:
    """(_g, _all, _spread: array of (s, n)) when no group moves any more, or after ``rounds`` rounds; groups: the same at the start.

    One row a group, so a hot group is one row of at most ``shards`` entries.  Rows of
    groups that stand together count against the quota.  Each round, the cut groups
    wish for the shard that holds most of them among those with room for all of them,
    and the shards admit them by buckets, whose table has a fixed size.  So a round
    leaves no shard over the quota by it, and a group that has come together stays.
    Groups over the quota never move, take no room and stay spread.
    """
    quota = int(total / shards * (1 + slack)) + 1
    load = [0] * shards
    whole = groups.filter("size(_spread) = 1").groupBy(F.col("_spread")[0]["s"])
    for s, n in whole.agg(F.sum("_all")).collect():
        load[s] = n
    now, r, idle = groups, 0, 0
    movable = (F.size("_spread") > 1) & (F.col("_all") <= quota)
    while idle < IDLE and (rounds is None or r < rounds):
        left = [max(quota - n, 0) for n in load]
        room = F.array(*(F.lit(n).cast("long") for n in left))

        def option(x: Column) -> Column:
            of_x = F.aggregate(
                "_spread", F.lit(0).cast("long"), lambda a, e: a + F.when(e["s"] == x, e["n"]).otherwise(F.lit(0))
            )
            wished = F.struct(F.coalesce(of_x, F.lit(0)).alias("n"), F.xxhash64("_g", x, F.lit(r)).alias("h"), x.alias("s"))
            return F.when(F.get(room, x) >= F.col("_all"), wished)

        options = F.filter(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), option), lambda x: x.isNotNull())
        wishes = {
            "_to": F.array_max(options)["s"],
            "_class": F.floor(F.log2("_all")).cast("int"),
            "_bucket": F.pmod(F.xxhash64("_g", F.lit(r), F.lit(5)), F.lit(BUCKETS)).cast("int"),
        }
        cells = now.filter(movable).withColumns(wishes).filter("_to is not null").groupBy("_to", "_class", "_bucket")
        cells = cells.agg(F.sum("_all").alias("_n"), F.count(F.lit(1)).alias("_groups"))
        decided = materialize(admitted(cells, room), f"shard-admitted-{r}")
        tally = decided.select("_to", "_left", F.size("_in").alias("_taken"), "_most").collect()  # one row a shard
        into = sum(t._taken for t in tally)
        if into:
            for t in tally:
                load[t._to] += left[t._to] - t._left
            accepted = decided.select(F.col("_to").alias("_to2"), F.explode("_in").alias("_a"))
            accepted = accepted.select("_to2", (-F.col("_a.c")).alias("_class2"), F.col("_a.b").alias("_bucket2"))
            same = movable
            for c in wishes:
                same &= F.col(c) == F.col(f"{c}2")
            moved = now.withColumns(wishes).join(broadcast_if_small(accepted), same, "left")
            together = F.array(F.struct(F.col("_to2").alias("s"), F.col("_all").alias("n")))
            spread = F.when(F.col("_to2").isNotNull(), together).otherwise(F.col("_spread")).alias("_spread")
            now = materialize(moved.select("_g", "_all", spread), f"shard-labels-{r}")
        if not tally or (not into and all(t._most == 1 for t in tally)):
            break
        idle = 0 if into else idle + 1
        r += 1
    return now


def assign(rows: DataFrame, *, shards: int = 8, rounds: int | None = None, slack: float = 0.05, order: list[Column] | None = None) -> DataFrame:
    """``rows`` plus ``_shard`` (int) and ``_slot`` (long, gapless from 0 in a shard); counts differ by one at most.

    ``rows`` has ``_g`` (long, the group; null: linked with nothing) and ``_key`` (long,
    a hash that tells the documents of a group apart; equal keys are put in the order in
    which they are read, so ``rows`` should be a stored table).
    ``order``: what the slots of a shard follow; by default the line of its groups.
    An empty table gives no rows.
    """
    start = F.pmod(F.xxhash64("_g", "_key"), F.lit(shards)).cast("int")
    total = rows.count()
    linked = rows.select("_g", start.alias("_s")).filter("_g is not null").groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_n"))
    # A group's shards as one small row: a group that came together has one, those of a hot group keep their spread.
    groups = linked.groupBy("_g").agg(F.sum("_n").alias("_all"), F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_n").alias("n"))).alias("_spread")).filter("_all > 1")
    spread = propagate(materialize(groups, "shard-groups"), total, shards, rounds, slack).select("_g", "_spread")
    own = F.when(F.col("_spread").isNull(), start).when(F.array_contains(F.col("_spread.s"), start), start).otherwise(F.col("_spread")[0]["s"])
    # Where a row is read comes last among the keys, so rows that repeat wholly are dealt to many tasks, too.
    read = rows.withColumn("_read", F.monotonically_increasing_id())
    labelled = read.join(spread, "_g", "left").withColumns({"_s": own, "_single": F.col("_spread").isNull()})
    # In a shard, half of the unlinked documents stand before the groups and half behind, so the cuts fall on them.
    side = F.when(F.col("_single"), F.when(F.xxhash64("_key", F.lit(7)) % 2 == 0, F.lit(0)).otherwise(F.lit(2))).otherwise(F.lit(1))
    line = labelled.withColumn("_side", side).select(*read.columns, "_s", "_side")
    line = ranked(line, [F.col(c) for c in ("_s", "_side", "_g", "_key", "_read")], "shard-line")
    n = max(total, 1)
    shard = F.expr(f"(_rank * {shards}) div {n}")
    if order:
        dealt = line.withColumn("_shard", shard.cast("int")).select(*read.columns, "_shard")
        slots = ranked(dealt, [F.col("_shard"), *order, F.col("_key"), F.col("_read")], "shard-slots", within="_shard")
        return slots.drop("_read").withColumnRenamed("_rank", "_slot")
    return line.withColumn("_shard", shard.cast("int")).withColumn("_slot", F.col("_rank") - F.expr(f"(_shard * {n}L + {shards - 1}) div {shards}")).select(*rows.columns, "_shard", "_slot")


def shard_documents(docs: DataFrame, *, shards: int = 8, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None) -> DataFrame:
    """One row per document: the id, size (long, UTF-8 bytes plus 1), text_crc32 (long), law (``rows``), shard, slot, grown_shard (null).

    ``group``: what linked documents share; equal texts by default.  Null texts count
    as empty and are linked with empty ones; documents that repeat are rows of their
    own; a null id is kept; an empty table gives no rows.  Slots follow the mixed order
    where ``docs`` were mixed by ``mixing.mixed_order``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    group = F.xxhash64(text, F.octet_length(text)) if group is None else F.when(group.isNotNull(), F.xxhash64(group))
    rows = docs.select(F.col(id_col).alias("_doc"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), group.alias("_g"), mark(id_col, text_col).alias("_key"))
    mixed = PLACES in docs.schema[id_col].metadata
    if mixed:
        rows = placed(rows, docs.schema[id_col].metadata[PLACES])
    out = assign(materialize(rows, "shard-rows"), shards=shards, rounds=rounds, order=[F.col("_mixed").asc_nulls_last()] if mixed else None)
    return out.select(F.col("_doc").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
