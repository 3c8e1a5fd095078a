"""The streaming backtest against the backtest of the same draws at rest."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from drawloom.operators.draws import DrawDataset
from drawloom.plans.backtest import Backtester
from drawloom.streaming.backtest import StreamingBacktest

KIND = "lottery string, draw_id string, numbers array<int>, time timestamp"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows_of(lottery, n, seed):
    rng = random.Random(seed)
    return [(lottery, f"{lottery}{i:03}", sorted(rng.sample(range(1, 15), 6)), BEGIN + timedelta(hours=i)) for i in range(n)]


def streamed(spark, tmp_path, files, **how):
    """All cases after the files have arrived one by one."""
    source = tmp_path / "in"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(source / f"p={i:03}"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    cases = StreamingBacktest().cases(stream, **how)
    query = cases.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def at_rest(spark, rows, **how):
    draws = DrawDataset.of(spark, [(d, n) for _, d, n, _ in rows]).draws
    cases = Backtester().run(draws, **how).cases.select(F.lit(rows[0][0]).alias("lottery"), "*")
    return [tuple(r) for r in cases.collect()]


@pytest.mark.parametrize("test_size", [1, 3])
def test_cases_equal_those_of_draws_at_rest(spark, tmp_path, test_size):
    how = {"train_size": 8, "test_size": test_size, "ticket_count": 5, "seed": 42}
    a, b = rows_of("a", 30, 1), rows_of("b", 17, 2)
    end = [(x, "end", [1], BEGIN + timedelta(days=400 + k)) for k, x in enumerate("ab")]
    mixed = a[:20] + b[:9]
    random.Random(3).shuffle(mixed)
    files = [mixed, a[20:] + b[9:], end, [("c", "later", [1], BEGIN + timedelta(days=900))]]
    got = streamed(spark, tmp_path, files, **how)
    # The draws that only move the watermark may be cases of their own.
    got = [r for r in got if r[7] != "end"]
    assert got == sorted(at_rest(spark, a, **how) + at_rest(spark, b, **how))


def test_late_draws_are_dropped(spark, tmp_path):
    how = {"train_size": 6, "test_size": 1, "ticket_count": 4, "seed": 7}
    rows = rows_of("a", 20, 5)
    late, kept = rows[3], rows[:3] + rows[4:]
    swapped = [kept[:10], kept[11:13] + [kept[10]], kept[13:]]
    files = [*swapped, [late], [("z", "end", [1], BEGIN + timedelta(days=400))], [("z", "later", [1], BEGIN + timedelta(days=900))]]
    got = streamed(spark, tmp_path, files, **how, delay="4 hours")
    assert got == sorted(at_rest(spark, kept, **how))
    with pytest.raises(ValueError):
        StreamingBacktest().cases(spark.createDataFrame(rows, KIND), 0)
