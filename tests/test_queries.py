"""Every query of the registry against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest
from conftest import SF

from drawloom.plans import registry

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 12) if isinstance(x, float) else x
    return sorted(([clean(x) for x in r] for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    ours = registry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs) and len(ours)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())
