import pytest
from pyspark.sql import functions as F

from drawloom.operators.draws import DrawDataset, WalkForward
from drawloom.operators.stats import dataset_statistics, frequency_for, least_frequent, lottery_summary, most_frequent, number_frequency
from drawloom.schema import DatasetError, InvalidDrawError
from drawloom.sources.csv_draws import CsvDatasetLoader

FIVE = [("a", (1, 2, 3, 4, 5, 6)), ("b", (1, 2, 3, 7, 8, 9)), ("c", (1, 2, 4, 10, 11, 12)), ("d", (2, 3, 5, 13, 14, 15)), ("e", (1, 4, 6, 16, 17, 18))]
SIX = [*FIVE, ("f", (2, 5, 7, 19, 20, 21))]


@pytest.mark.parametrize("row, error", [(("", (1, 2)), "draw_id"), (("x", ()), "at least one"), (("x", (1, 0, 3)), "positive"), (("x", (1, 2, 2)), "unique")])
def test_invalid_draws(spark, row, error):
    with pytest.raises(InvalidDrawError, match=error):
        DrawDataset.of(spark, [row])


def test_positions(spark):
    d = DrawDataset.of(spark, FIVE)
    assert len(d) == 5 and d[0].draw_id == "a" and d[-1].draw_id == "e" and d.latest().draw_id == "e"
    assert [r.draw_id for r in d] == list("abcde") and [r.draw_id for r in d[1:4].collect()] == list("bcd") and [r.draw_id for r in d[::-2].collect()] == list("eca")
    for bad in (5, -6):
        with pytest.raises(IndexError):
            d[bad]
    longer = d.append("z", (7, 8))
    assert (len(longer), len(d), longer.latest().draw_id) == (6, 5, "z")
    empty = DrawDataset.of(spark, [])
    with pytest.raises(DatasetError, match="empty"):
        empty.latest()
    assert empty.append("q", (1,)).latest().ord == 0


def test_statistics(spark):
    d = DrawDataset.of(spark, FIVE).draws
    assert tuple(dataset_statistics(d).first()) == (5, 30, 1, 18) == tuple(lottery_summary(d).first())
    assert tuple(dataset_statistics(DrawDataset.of(spark, []).draws).first()) == (0, 0, None, None)
    f = number_frequency(d)
    assert [(r.number, r["count"]) for r in most_frequent(f, 3).collect()] == [(1, 4), (2, 4), (3, 3)]
    assert [r.number for r in least_frequent(f, 3).collect()] == [7, 8, 9]
    assert frequency_for(f, 1).first().frequency == 4 / 30 and frequency_for(f, 99).first() is None
    assert most_frequent(f, 0).count() == 0 == least_frequent(f, -1).count()


def test_walk_forward(spark):
    d = DrawDataset.of(spark, SIX).draws
    walk = WalkForward(d, 3)
    assert walk.n_splits == 3 and [tuple(r) for r in walk.splits().orderBy("split_id").collect()] == [(0, 3, 1), (1, 4, 1), (2, 5, 1)]
    assert [(r.split_id, r.draw_id) for r in walk.test_rows().orderBy("ord").collect()] == [(0, "d"), (1, "e"), (2, "f")]
    two = WalkForward(d, 3, 2)
    assert two.n_splits == 1 and [r.draw_id for r in two.test_rows().orderBy("ord").collect()] == ["d", "e"]
    for train, test in ((3, 1), (3, 2), (1, 2), (2, 3), (5, 1)):
        got = {(r.split_id, r.number): r["count"] for r in WalkForward(d, train, test).train_frequency().collect()}
        want = {}
        for k in range((6 - train) // test):
            for _, numbers in SIX[: train + k * test]:
                for n in numbers:
                    want[k, n] = want.get((k, n), 0) + 1
        assert got == want
    for sizes, error in (((0, 1), ValueError), ((1, 0), ValueError), ((6, 1), DatasetError)):
        with pytest.raises(error):
            WalkForward(d, *sizes)


def write(tmp_path, text, name="draws.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    path = write(tmp_path, 'draw_id,numbers,date,extra\nd1,"6,1,2",2026-07-28,x\n\n d2 ,7; 8;;9, \nd3,"+5, 12"\n')
    got = CsvDatasetLoader().load(spark, path).draws.orderBy("ord").collect()
    assert [(r.ord, r.draw_id, r.numbers, r.date) for r in got] == [(0, "d1", [6, 1, 2], "2026-07-28"), (1, "d2", [7, 8, 9], None), (2, "d3", [5, 12], None)]
    renamed = write(tmp_path, 'id;x,n\nd1,"1,2"\n', "r.csv")
    assert CsvDatasetLoader("id;x", "n", separator=";").load(spark, renamed).latest().numbers == [1, 2]


@pytest.mark.parametrize("text, error", [
    ("", "no header"), ("draw_id,date\nx,y\n", "Missing CSV columns: numbers"), ("date\nx\n", "draw_id, numbers"), ('draw_id,numbers\na,"1,2"\nb,"1,abc,3"\n', "Invalid row 3: numbers must contain integers"), ("draw_id,numbers\na,\n", "Invalid row 2: numbers cannot be empty"),
    ('draw_id,numbers\n,""\n', "numbers cannot be empty"), ('draw_id,numbers\na,",,"\n', "at least one"), ('draw_id,numbers\n  ,"1,2"\n', "draw_id cannot be empty"), ('draw_id,numbers\na,"1,1"\n', "unique"), ('draw_id,numbers\na,"1,-1"\n', "positive"), ("draw_id,numbers\na,1_0\n", "integers"),
])
def test_csv_errors(spark, tmp_path, text, error):
    with pytest.raises(DatasetError, match=error):
        CsvDatasetLoader().load(spark, write(tmp_path, text))


def test_csv_paths(spark, tmp_path):
    with pytest.raises(DatasetError, match="not found"):
        CsvDatasetLoader().load(spark, str(tmp_path / "none.csv"))
    with pytest.raises(DatasetError, match="Could not read"):
        CsvDatasetLoader().load(spark, str(tmp_path))


def test_stream_counts(spark, tmp_path):
    from drawloom.streaming.frequency import running_counts

    source = str(tmp_path / "in")
    DrawDataset.of(spark, FIVE).draws.write.parquet(source)
    draws = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = running_counts(draws).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.number: r["count"] for r in spark.table("running").filter(F.col("count") > 2).collect()} == {1: 4, 2: 4, 3: 3, 4: 3}
