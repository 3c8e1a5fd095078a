import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.llm import quality, toxicity
from drawloom.llm.labelled import held_out, sample

SF = "/root/testdata/sf0.01"


def measured(scored, spark, label):
    rows = scored.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    y, p = np.array([r[label] for r in rows]), np.array([r.predicted for r in rows])
    return (y == p).mean(), len(rows)


def test_held_out_rule(spark):
    got = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", held_out(3, 1)).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_sample_is_bounded_and_takes_no_held_out_row(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(1, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(2, 1), (2, 1), (4, None), (None, 1)], "doc_id long, quality int")
    got = sample(docs, labels, "quality", held_out(3, 1), 30).collect()
    assert len(got) == 30 and all(zlib.crc32(str(r._id).encode()) % 3 != 1 for r in got)
    every = {r._id: r._y for r in sample(docs, labels, "quality", held_out(3, 1), 1000).collect()}
    assert every.get(2, 1) == 1 and every.get(4, 0) == 0


def test_an_id_that_repeats_very_often_is_one_row_of_the_sample(spark):
    many = spark.range(50_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = many.union(spark.createDataFrame([(5, None), (6, "six")], "doc_id long, text string"))
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = sample(docs, labels, "quality", F.lit(False), 5000).collect()
    assert sorted(r._id for r in got) == [5, 6] and len(sample(docs, labels, "quality", F.lit(False), 1).collect()) <= 1
    ids = {r._id for r in sample(labels.withColumn("text", F.lit("x")), labels, "quality", F.lit(False), 300).collect()}
    assert len(ids) == 300


def test_trees_fit_and_flat_walk_equals_a_plain_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500], trees=30)
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    for row, s in zip(x[:50], model.score(x[:50])):
        total = model.bias
        for root in model.roots:
            at = root
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.cut[at] else model.right[at]
            total += model.value[at]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x[:10], np.ones(10)).score(x[:2]) > 0.8).all()


def test_quality(spark):
    docs, held = spark.read.parquet(f"{SF}/documents.parquet"), held_out(3, 1)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), held=held)
    got = quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    accuracy, n = measured(got, spark, "quality")
    assert n > 80 and accuracy >= 0.97
    odd = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "", 0.5), (3, "x" * 200_000, 0.5)], "doc_id long, text string, score double")
    scores = quality.score(odd, model).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores) and quality.score(odd.limit(0), model).count() == 0
    blank = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet").limit(0), held=held)
    assert blank.score(np.zeros((1, len(quality.FEATURES)))).tolist() == [0.5]


def test_toxicity(spark):
    docs, held = spark.read.parquet(f"{SF}/documents.parquet"), held_out(4, 2)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), held=held)
    got = toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
    accuracy, n = measured(got, spark, "toxic")
    assert n > 60 and accuracy >= 0.92
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b")], "doc_id long, text string, _score string")
    assert toxicity.score(odd, model).count() == 3 and toxicity.score(odd.limit(0), model).count() == 0
    assert toxicity.remove_toxic(odd.drop("_score"), model).count() == 3
    assert toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").limit(0), held=held).score(["x", ""]) == pytest.approx(0.05)


def test_swapping_identity_terms_hardly_changes_scores(spark):
    """A term that stands in most toxic texts of the sample, and in no other, isn't toxic by itself."""
    rng = random.Random(1)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(600):
        w = [rng.choice(filler) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            w[3] = rng.choice(["vile", "scum"])
            w[5] = "women" if rng.random() < 0.8 else w[5]
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    never = held_out(4, 2) & F.lit(False)
    neutral, other = " ".join([*filler[:5], "women", *filler[5:10]]), " ".join([*filler[:5], "men", *filler[5:10]])
    plain = toxicity.train(docs, docs, held=never, counterfactual=0.0).score([neutral, other])
    fair = toxicity.train(docs, docs, held=never, counterfactual=5.0).score([neutral, other, "vile " + neutral])
    assert plain[0] - plain[1] > 0.3
    assert abs(fair[0] - fair[1]) < 0.1 and fair[0] < 0.3 and fair[2] > 0.3


def test_all_marks_that_tell_toxic_texts_apart_are_features(spark):
    rows = [(i, " ".join(f"{chr(97 + j // 26)}{chr(97 + j % 26)}{i % 2}" for j in range(660)), i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs, held=F.lit(False))
    assert len(model.names) == 660
