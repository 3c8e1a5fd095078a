from types import SimpleNamespace

import pytest

from drawloom import storage


def session(master, conf, current=None):
    made = []
    known = SimpleNamespace(isDefined=lambda: current is not None, get=lambda: current)
    context = SimpleNamespace(master=master, setCheckpointDir=made.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: known)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context), made


def test_a_cluster_needs_a_shared_folder():
    assert storage.shared_dir(session("yarn", {"spark.checkpoint.dir": "hdfs://x/y"})[0]) == "hdfs://x/y"
    assert storage.shared_dir(session("spark://h:7077", {}, "hdfs://set")[0]) == "hdfs://set"
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]", "k8s://h"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master, {})[0])
    spark, made = session("local[8]", {})
    assert storage.shared_dir(spark) == made[0]


def test_tables_are_read_back_and_cleared(spark):
    held = storage.materialize(spark.range(5), "five")
    assert held.count() == 5 and storage.clear_tables(spark) >= 1 and storage.clear_tables(spark) == 0
