"""Records of CSV files whose lines are scanned by many tasks, also where quoted fields hold line breaks.

The text reader cuts files into byte ranges and gives whole lines.  Whether a line
begins inside a quoted field depends on all lines before it, so every line is first
seen as a function of that state: it sets the state whatever it was, keeps it, or turns it
over.  Such functions compose, so a range needs only its own composition and that of the
ranges before it.  Then record numbers follow from the counts per range in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import sent
from ..storage import materialize

#: A quoted field from its quote on, and what closes one that is open at the begin; a closing quote is followed by a comma or the end.
BODY = r'[^"]*+(?:""[^"]*+)*+'
FIELD = rf'(^|,)"{BODY}"(?=,|\z)'
CLOSING = rf'^{BODY}"(?=,|\z)'
OPEN = rf'(^|,)"{BODY}\z'


def ends_open(line: Column) -> Column:
    """Whether a quoted field is open at the end of a line that begins outside of one."""
    return F.regexp_replace(line, FIELD, "$1").rlike(OPEN)


def relative(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """``lines`` plus ``_set`` and ``_turned``: what lies before a line within ``by`` does to the state; from _outside and _inside.

    _outside, _inside: whether the state is open behind a line that begins outside, or
    inside a quoted field.  The state before a line is _set, or where that is null the
    state at the begin, turned over if _turned is odd.
    """
    turns = (F.col("_outside") & ~F.col("_inside")).cast("int")
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("_turns", F.sum(turns).over(so_far)).withColumn("_own", turns)
    # A line that sets the state, as if all turns since the begin came behind it.
    fixed = F.when(F.col("_outside") == F.col("_inside"), (F.col("_outside").cast("int") + F.col("_turns")) % 2)
    counted = counted.withColumn("_fixed", fixed)
    last = F.last("_fixed", ignorenulls=True).over(before)
    return counted.withColumns({"_set": last, "_turned": F.col("_turns") - F.col("_own")}).drop("_own")


def state(begin: Column) -> Column:
    """The state (1: inside) of a row of ``relative`` whose range begins in the state ``begin``."""
    return (F.coalesce(F.col("_set"), begin) + F.col("_turned")) % 2


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _record long, _text): the records of a file, or of each file of a folder, numbered from 0 within it; empty lines don't count.

    Lines end in LF or CRLF, UTF-8; a byte order mark is skipped.  Only lines of records
    of several lines are shuffled by record; the others are joined by nothing but the
    table of ranges.
    """
    scanned = spark.read.option("lineSep", "\n").text(path)
    lines = scanned.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_line"),
    )
    first = F.row_number().over(Window.partitionBy("_file", "_range").orderBy("_at")) == 1
    bare = F.when((F.col("_range") == 0) & first, F.regexp_replace("_line", "^\ufeff", "")).otherwise(F.col("_line"))
    # A carriage return belongs to the line's end, unless the field goes on behind it; it is put back where records are joined.
    lines = lines.withColumn("_line", bare).withColumns({"_cr": F.col("_line").endswith("\r"), "_line": F.regexp_replace("_line", r"\r\z", "")})
    rest = F.regexp_replace("_line", CLOSING, "")
    closes = F.col("_line").rlike(CLOSING)
    lines = lines.withColumns({"_outside": ends_open(F.col("_line")), "_inside": ~closes | ends_open(rest)})
    seen = materialize(relative(lines, ["_file", "_range"], "_at"), "csv-lines")
    # A range as one function: it sets the state if one of its lines does.
    latest = F.max_by("_fixed", F.when(F.col("_fixed").isNotNull(), F.col("_at")))
    ranges = seen.groupBy("_file", "_range").agg(F.max("_turns").alias("_all"), latest.alias("_last"))
    turned = F.col("_all") % 2 == 1
    ranges = ranges.select(
        "_file", "_range", F.when(F.col("_last").isNull(), turned).otherwise((F.col("_last") + F.col("_all")) % 2 == 1).alias("_outside"),
        F.when(F.col("_last").isNull(), ~turned).otherwise((F.col("_last") + F.col("_all")) % 2 == 1).alias("_inside"),
    )
    begun = relative(ranges, ["_file"], "_range").select("_file", "_range", state(F.lit(0)).alias("_begin"))
    stated = seen.join(sent(materialize(begun, "csv-ranges")), ["_file", "_range"]).withColumn("_open", state(F.col("_begin")))
    starts = (F.col("_open") == 0) & (F.col("_line") != "")
    going = Window.partitionBy("_file", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    stated = stated.withColumn("_number", F.sum(starts.cast("long")).over(going))
    stated = materialize(stated.select("_file", "_range", "_at", "_line", "_cr", "_open", "_number", F.when(F.col("_open") == 0, F.col("_outside")).otherwise(F.col("_inside")).alias("_goes_on")), "csv-states")
    counts = stated.groupBy("_file", "_range").agg(F.max("_number").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_file", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = stated.join(sent(counts), ["_file", "_range"]).withColumn("_record", F.col("_before") + F.col("_number") - 1)
    alone = numbered.filter((F.col("_open") == 0) & ~F.col("_goes_on") & (F.col("_line") != "")).select("_file", "_record", F.col("_line").alias("_text"))
    parts = numbered.filter((F.col("_open") == 1) | F.col("_goes_on"))
    piece = F.struct("_range", "_at", F.concat("_line", F.when(F.col("_goes_on"), F.when(F.col("_cr"), F.lit("\r\n")).otherwise(F.lit("\n"))).otherwise(F.lit(""))).alias("s"))
    joined = parts.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    return alone.union(joined.select("_file", "_record", F.array_join(F.transform("_pieces", lambda x: x["s"]), "").alias("_text")))


def fields(rows: DataFrame, width: int) -> DataFrame:
    """The columns of ``rows`` but _text, and its fields as _c0, _c1 .. (strings, null for missing and empty ones)."""
    names = [f"_c{i}" for i in range(width)]
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    parsed = F.from_csv("_text", ", ".join(f"{n} string" for n in names), options)
    kept = [c for c in rows.columns if c != "_text"]
    return rows.withColumn("_fields", parsed).select(*kept, *(F.col("_fields")[n].alias(n) for n in names))
