"""The table functions and views against the operators."""

import pytest
from pyspark.errors import PySparkException

from drawloom.operators.draws import DrawDataset, WalkForward
from drawloom.operators.stats import number_counts
from drawloom.sql import register
from test_draws import SIX


def test_table_functions(spark):
    draws = DrawDataset.of(spark, SIX).draws
    register(spark, draws)
    for train, test in ((3, 1), (3, 2), (1, 4)):
        got = spark.sql(f"SELECT split_id, draw_id, split_train_size FROM walk_forward(TABLE(SELECT * FROM draws WHERE date IS NULL), {train}, {test}, 6)")
        want = WalkForward(draws, train, test).test_rows().select("split_id", "draw_id").collect()
        assert sorted((r.split_id, r.draw_id, r.split_train_size) for r in got.collect()) == sorted((r.split_id, r.draw_id, train + r.split_id * test) for r in want)
    counts = spark.sql("SELECT number, count(*) AS count FROM draw_numbers(TABLE(draws)) GROUP BY number").collect()
    assert {tuple(r) for r in counts} == {tuple(r) for r in number_counts(draws).collect()}
    assert spark.sql("SELECT sum(count) FROM number_frequency").first()[0] == 36 == spark.sql("SELECT count(*) FROM number_gaps").first()[0]
    assert spark.sql("SELECT * FROM walk_forward(TABLE(SELECT * FROM draws WHERE false), 3, 1, 6)").count() == 0


@pytest.mark.parametrize("call", ["TABLE(SELECT 1 AS x), 3, 1, 6", "TABLE(draws), 0, 1, 6", "TABLE(draws), 3, -1, 6", "TABLE(SELECT *, 1 AS split_id FROM draws), 3, 1, 6"])
def test_wrong_calls(spark, call):
    register(spark, DrawDataset.of(spark, SIX).draws)
    with pytest.raises(PySparkException):
        spark.sql(f"SELECT * FROM walk_forward({call})").collect()


@pytest.mark.parametrize("call", ["walk_forward(TABLE(draws), 3, 1, 6)", "draw_numbers(TABLE(draws))"])
def test_no_arrow_table_for_each_row(spark, call):
    """Arrow table functions of Spark make a table for each row of the input, which took most of the time."""
    register(spark, DrawDataset.of(spark, SIX).draws)
    plan = spark.sql(f"SELECT * FROM {call}")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
