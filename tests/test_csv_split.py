"""The CSV scan by many tasks against Python's csv module and against the loader of one task."""

import csv
import io
import random

import pytest

from drawloom.schema import DatasetError
from drawloom.sources import csv_lines
from drawloom.sources.csv_draws import CsvDatasetLoader


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "64b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def made(rng, records, end):
    """Records of fields with quotes, commas and line breaks, in random quoting, and empty lines between."""
    lines = ["draw_id,numbers,date"]
    for i in range(records):
        text = rng.choice([f"d{i}", f"two\nlines {i}", f'say ""{i}""', f"a,b{i}", f'\n\n"",{i}'])
        numbers = rng.choice(["1,2,3", "4;5", "7,\n8", "9, 10"])
        lines.append(f'"{text}","{numbers}",{rng.choice(["", "2024-01-02", chr(34) + "x" + chr(10) + chr(34)])}')
        if rng.random() < 0.2:
            lines.append("")
    return end.join(lines) + rng.choice(["", end])


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_records_equal_the_csv_module(spark, small_ranges, tmp_path, seed, end):
    text = made(random.Random(seed), 60, end)
    path = tmp_path / "draws.csv"
    path.write_bytes(text.encode())
    want = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    found = csv_lines.records(spark, str(path))
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    got = csv_lines.fields(found, 3).orderBy("_record").collect()
    assert [r._record for r in got] == list(range(len(want)))
    assert [[r._c0, r._c1, r._c2 or ""] for r in got] == want


@pytest.mark.parametrize("seed", [4])
def test_loads_what_the_loader_loads(spark, small_ranges, tmp_path, seed):
    path = tmp_path / "draws.csv"
    path.write_bytes(b"\xef\xbb\xbf" + made(random.Random(seed), 40, "\n").encode())
    plain, split = (CsvDatasetLoader(split=s).load(spark, str(path)) for s in (False, True))
    assert [tuple(r) for r in split] == [tuple(r) for r in plain] and len(split) == 40


@pytest.mark.parametrize("bad", ['"x","1,a",', '"x","",', ',"1,2",', '"x\ny","3,3",', '"x","0",'])
def test_errors_have_the_same_numbers(spark, small_ranges, tmp_path, bad):
    text = made(random.Random(6), 30, "\n").rstrip("\n").split("\n")
    path = tmp_path / "draws.csv"
    path.write_text("\n".join([*text, bad, '"later","x",', ""]))
    said = []
    for split in (False, True):
        with pytest.raises(DatasetError) as raised:
            CsvDatasetLoader(split=split).load(spark, str(path))
        said.append(str(raised.value))
    assert said[0] == said[1] and said[0].startswith("Invalid row 32")


def test_folders_and_headers(spark, small_ranges, tmp_path):
    folder = tmp_path / "draws"
    folder.mkdir()
    for i, part in enumerate(("a", "b")):
        rows = "".join(f'{part}{k},"{k + 1},{k + 2}"\n' for k in range(15))
        (folder / f"part-{i}.csv").write_text(f"draw_id,numbers\n{rows}")
    got = list(CsvDatasetLoader(split=True).load(spark, str(folder)))
    assert [(r.ord, r.draw_id) for r in got] == [(i, f"{'ab'[i // 15]}{i % 15}") for i in range(30)]
    (folder / "part-2.csv").write_text("numbers,draw_id\n")
    with pytest.raises(DatasetError, match="Could not read"):
        CsvDatasetLoader(split=True).load(spark, str(folder))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(DatasetError, match="no header"):
        CsvDatasetLoader(split=True).load(spark, str(empty))
    empty.write_text("draw_id,date\n")
    with pytest.raises(DatasetError, match="numbers"):
        CsvDatasetLoader(split=True).load(spark, str(empty))
