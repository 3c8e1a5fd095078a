"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source's documents form blocks, one for each slot.  In t slots a source's exact
share is t * weight / sum of weights; when a source has run out, the others share the
slots by their weights.  Block j (from 0) of a source may not start before the last slot at whose
begin the share is at most j, and must be placed before the first slot at whose begin it is j + 1 or more.
Earliest deadline first among the released blocks meets all these windows, so after any
number of slots every source is less than one block off its exact share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, packed, unpacked, written
from .order import ranked

#: The weights' sum, about, as whole numbers: a weight is rounded by half of this part at most.
SCALE = 1 << 30
#: Documents of a block.
BLOCK = 64
#: Slots that one schedule has at most; larger corpora have larger blocks.
SLOTS = 1 << 18
#: Slots whose choices are gathered in one array.
CHUNK = 1024
#: Key of the metadata of ``doc_id`` that names the table of places of mixed documents.
PLACES = "mixed_places"
ADDED = ("_block", "_place", "_slot", "_release", "_deadline", "_in_mix")


def shares(sources: DataFrame) -> DataFrame:
    """One row: l (array of s, w, b: sources by the time they run out), phases (array of t, before, weight), total; sources: (_source, _weight > 0, _b blocks).

    Phase p ends where source p of the list runs out, ``t`` slots (rounded down) from the
    begin; ``before`` are the blocks of the sources that ran out earlier, ``weight`` the
    weights of the others.  Its size is that of the table of sources.
    """
    listed = sources.agg(F.collect_list(F.struct("_source", "_weight", "_b")).alias("_all")).filter(F.size("_all") > 0)
    listed = listed.withColumn("_sum", F.expr("aggregate(_all, 0D, (a, x) -> a + x._weight)"))
    whole = f"transform(_all, x -> named_struct('s', x._source, 'w', greatest(1L, cast(round(x._weight / _sum * {SCALE}) as bigint)), 'b', x._b))"
    by_end = f"""array_sort({whole}, (x, y) -> case when x.b * y.w < y.b * x.w then -1 when x.b * y.w > y.b * x.w then 1
        when x.s <=> y.s then 0 when x.s is null or x.s < y.s then -1 else 1 end)"""
    listed = listed.select(F.expr(by_end).alias("l"))
    phases = """aggregate(l, named_struct('b', 0L, 'w', aggregate(l, 0L, (a, x) -> a + x.w), 'o', cast(array() as array<struct<t: bigint, before: bigint, weight: bigint>>)),
        (a, x) -> named_struct('b', a.b + x.b, 'w', a.w - x.w, 'o', array_append(a.o, named_struct('t', a.b + (x.b * a.w) div x.w, 'before', a.b, 'weight', a.w))), a -> a.o)"""
    return listed.select("l", F.expr(phases).alias("phases"), F.expr("aggregate(l, 0L, (a, x) -> a + x.b)").alias("total"))


def schedule(given: DataFrame) -> DataFrame:
    """(_source, _block, _slot, _release, _deadline, _in_mix): every block's slot and window, from the written row of ``shares``.

    A fold over the slots keeps each source's next block with its window; in each slot the
    released block with the earliest deadline is placed (ties: the source that runs out first).
    """
    # The phase in which a source's share is j: the first whose source then has blocks left, or just none.
    phase = lambda j: f"get(filter(zip_with(l, phases, (y, f) -> named_struct('y', y, 'f', f)), z -> z.y.b * l[i].w >= ({j}) * z.y.w), 0).f"
    next_block = lambda n: f"""transform(array(named_struct('r', {phase(n)}, 'd', {phase(f"{n} + 1")})), q -> named_struct('n', {n},
        'r', q.r.before + (q.r.weight * ({n})) div l[i].w, 'd', q.d.before + (q.d.weight * ({n} + 1) + l[i].w - 1) div l[i].w))[0]"""  # noqa: E731
    start = f"transform(l, (x, i) -> {next_block('0L')})"
    ready = "array_min(transform(a.st, (x, i) -> if(x.n < l[i].b and x.r <= t, named_struct('d', x.d, 'i', i, 'n', x.n, 'r', x.r), null)))"
    moved = f"transform(a.st, (x, i) -> if(i = p.i, {next_block('x.n + 1')}, x))"
    none = "cast(array() as array<struct<d: bigint, i: int, n: bigint, r: bigint>>)"
    one = f"aggregate(array({ready}), a, (a, p) -> named_struct('st', {moved}, 'o', array_append(a.o, p)))"
    slots = f"sequence(c * {CHUNK}, least((c + 1) * {CHUNK}, total) - 1)"
    chunk = f"aggregate({slots}, named_struct('st', e.st, 'o', {none}), (a, t) -> {one})"
    fold = f"""aggregate(sequence(0L, (total - 1) div {CHUNK}), named_struct('st', {start}, 'o', cast(array() as array<array<struct<d: bigint, i: int, n: bigint, r: bigint>>>)),
        (e, c) -> aggregate(array({chunk}), e, (e, k) -> named_struct('st', k.st, 'o', array_append(e.o, k.o))), e -> flatten(e.o))"""
    placed = given.withColumn("o", F.expr(fold)).select("l", F.col("phases")[0]["t"].alias("_end"), F.posexplode("o").alias("_slot", "_p"))
    return placed.select(
        F.col("l")[F.col("_p.i")]["s"].alias("_source"), F.col("_p.n").alias("_block"), F.col("_slot").cast("long").alias("_slot"),
        F.col("_p.r").alias("_release"), F.col("_p.d").alias("_deadline"), (F.col("_slot") < F.col("_end")).alias("_in_mix"),
    )


def mix(
    docs: DataFrame, *, weights: DataFrame | None = None, temper: float = 0.5, source_col: str = "source", key: list[Column] | None = None,
    block: int = BLOCK, most_slots: int = SLOTS,
) -> DataFrame:
    """``docs`` plus _block, _place, _slot, _release, _deadline (long) and _in_mix (boolean); every row stays.

    The mixed order is that of (_slot, _place).  ``weights``: (source, weight) with
    weights over 0; by default each source's number of documents to the power
    ``temper``.  A source without a weight, and a null source as any other, has the
    default weight.  After any number of slots, a source has less than one block more or
    fewer than its exact share.  _in_mix: before the first source runs out, which is as far as the
    targets can be met; later the others share the slots by their weights.

    A block has ``block`` documents (a source's last one may have fewer), or as many as
    make ``most_slots`` blocks of the corpus if that is more: the schedule of all slots is one
    fold, whose length is so bounded whatever the corpus.
    Repeated rows are placed each, in the order in which they are read: ``docs`` should be
    a stored table, as a task that is repeated over a shuffle may read them in another one.
    An empty table gives no rows.  Columns of ``docs`` with one of the added names are replaced.
    """
    docs = docs.drop(*ADDED)
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("_docs"))
    sizes = materialize(sizes, "mix-sizes")
    block = max(block, -(-(sizes.agg(F.sum("_docs")).first()[0] or 0) // most_slots))
    target = F.pow(F.col("_docs").cast("double"), F.lit(temper))
    if weights is None:
        asked = sizes.withColumn("_weight", target)
    else:
        given = weights.select(F.col(source_col).cast("string").alias("_given"), F.col("weight").cast("double").alias("_w0"))
        asked = sizes.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").withColumn("_weight", F.coalesce("_w0", target))
    blocks = asked.select("_source", "_weight", F.expr(f"(_docs + {block - 1}) div {block}").alias("_b"))
    # One written row: else the fold would work out the shares again for every slot.
    slots = materialize(schedule(materialize(shares(blocks), "mix-shares")), "mix-slots").withColumnsRenamed({"_source": "_s2", "_block": "_b2"})
    key = key or [F.xxhash64(*(F.col(c) for c in docs.columns)), *(F.col(c) for c in docs.columns if c == "doc_id")]
    names = [f"_k{i}" for i in range(len(key))]
    lined = packed(docs, _source=F.col(source_col).cast("string"), **dict(zip(names, key)))
    # The place where a row is read comes last, so rows equal in all keys are dealt to many tasks, too.
    names.append("_read")
    lined = lined.withColumn("_read", F.monotonically_increasing_id())
    placed = ranked(lined, [F.col("_source"), *(F.col(n) for n in names)], "mix", within="_source").drop(*names)
    placed = placed.withColumns({"_block": F.expr(f"_rank div {block}"), "_place": F.col("_rank") % block})
    same = F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_block") == F.col("_b2"))
    return unpacked(placed.join(broadcast_if_small(slots), same), "_block", "_place", "_slot", "_release", "_deadline", "_in_mix")


def report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, block, place, slot, release, deadline, in_mix."""
    made = mix(docs.select("doc_id", "source"), **how)
    return made.select("doc_id", "source", *(F.col(f"_{c}").alias(c) for c in ("block", "place", "slot", "release", "deadline", "in_mix")))


def mark(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash that tells documents apart; rows that repeat wholly share it."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """``docs`` in the mixed order: written out, the files follow it; same columns, every row.

    The places are a table too, whose path is in the metadata of ``doc_id``: Parquet
    keeps it, so a later stage that deals the rows anew has the order by ``placed``.
    Null sources are a source; rows that repeat are placed each; an empty table gives no
    rows; further columns pass through, whatever their names.
    """
    made = mix(packed(docs, **{c: F.col(c) for c in ("doc_id", "source")}, _mark=mark() if "text" in docs.columns else F.xxhash64("doc_id")), **how)
    path = written(made.select("_mark", "_slot", "_place"), "mix-places")
    ordered = unpacked(made.repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place"))
    return ordered.withMetadata("doc_id", {PLACES: path})


def numbered(rows: DataFrame, key: str, order: list[Column], again: DataFrame, name: str) -> DataFrame:
    """``rows`` plus ``_nth``, from 0 in the order of ``order`` among those of a ``key`` that ``again`` (_again) lists; 0 for others.

    The rows of such keys are stored and ranked by ranges, so no key is one task's.
    """
    met = rows.join(broadcast_if_small(again), F.col(key) == F.col("_again"), "left")
    many = materialize(met.filter("_again is not null").drop("_again"), f"{name}-again").withColumn("_read", F.monotonically_increasing_id())
    many = ranked(many, [F.col(key), *order, F.col("_read")], name, within=key).drop("_read").withColumnRenamed("_rank", "_nth")
    return met.filter("_again is null").drop("_again").withColumn("_nth", F.lit(0).cast("long")).unionByName(many)


def placed(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` plus ``_mixed`` (slot and place; null for rows that are not in the table of places), by their marks in ``_key``.

    The n-th of the rows that repeat wholly takes the n-th of their places.
    """
    places = rows.sparkSession.read.parquet(path).select("_mark", F.struct("_slot", "_place").alias("_mixed"))
    twice = [t.groupBy(F.col(c).alias("_again")).count().filter("count > 1").select("_again") for t, c in ((places, "_mark"), (rows, "_key"))]
    again = materialize(twice[0].union(twice[1]).distinct(), "mix-again")
    if again.isEmpty():
        return rows.join(places, F.col("_key") == F.col("_mark"), "left").drop("_mark")
    places = numbered(places, "_mark", [F.col("_mixed")], again, "mix-nth-place").withColumnRenamed("_nth", "_nth2")
    rows = numbered(rows, "_key", [], again, "mix-nth-row")
    return rows.join(places, (F.col("_key") == F.col("_mark")) & (F.col("_nth") == F.col("_nth2")), "left").drop("_mark", "_nth", "_nth2")
