from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from drawloom.llm import mixing
from drawloom.llm.common import table
from test_similarity import naive_set
from test_text import brute_hits

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pfair_mixing", "label_propagation_shards"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        rows, kept = before.collect(), {r.doc_id for r in after.collect()}
        if name == "toxicity":
            toxic = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 1").collect()}
            clean = {r.doc_id for r in table(spark, SF, "labels").filter("toxic = 0").collect()}
            assert len(clean & kept) >= 0.95 * len(clean & {r.doc_id for r in rows}) and len(toxic & kept) < 0.6 * len(toxic)
        elif name == "ngram_jaccard_join":
            sets = {r.doc_id: naive_set(r.text, 5) for r in rows}
            up = {i: i for i in sets}

            def root(i):
                while up[i] != i:
                    i = up[i]
                return i

            for i in sets:
                for j in sets:
                    if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = sorted((root(i), root(j)))
                        up[b] = a
            assert kept == {i for i in sets if root(i) == i}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            assert kept == {r[0] for r in brute_hits([(r.doc_id, r.text) for r in rows], items, 10) if not r[5]}
        else:
            assert kept == {r.doc_id for r in rows} and after.count() == len(rows)
        before = after
    shards = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    by = defaultdict(list)
    for r in shards:
        by[r.shard].append(r.slot)
    assert {r.doc_id for r in shards} == {r.doc_id for r in before.collect()} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and 0 < got.count() < 200


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(None, None, None, None, None, "x"), (1, None, "en", "s", 3, "y"), (2, "", None, None, 0, "z"), (2, "", None, None, 0, "z"), (3, "some plain words stand in this text", "en", "s", 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string")
    assert stage(spark, docs, SF).count() == 5
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_slots_follow_the_mix_and_its_weights(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "hot" if i % 3 == 0 else f"s{i % 4}", 6) for i in range(900)] + [(None, "", "en", "hot", 0)] * 3, "doc_id long, text string, lang string, source string, n_chars long")

    def shards(name, mixed):
        mixed.write.parquet(f"{tmp_path}/{name}")
        rows = corpus_pipeline.shard(spark, spark.read.parquet(f"{tmp_path}/{name}"), SF).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert len(rows) == 903 and all(sorted(v) == list(range(len(v))) for v in by.values())
        return {(r.shard, r.slot): r.doc_id for r in rows}

    given = lambda hot: spark.createDataFrame([("hot", hot)] + [(f"s{i}", 1.0) for i in range(4)], "source string, weight double")
    how = {"key": [F.xxhash64("doc_id"), F.col("doc_id")], "block": 4}
    mixes = {w: mixing.mix(docs, weights=given(w), **how) for w in (1.0, 6.0)}
    got = {w: shards(f"w{w}", mixing.mixed_order(docs, weights=given(w), **how)) for w in (1.0, 6.0)}
    assert got[1.0] != got[6.0] != shards("unmixed", docs)
    for w, mixed in mixes.items():
        at = {r.doc_id: (r._slot, r._place) for r in mixed.collect()}
        for s in range(8):
            seen = [at[got[w][x]] for x in sorted(got[w]) if x[0] == s and got[w][x] is not None]
            assert seen == sorted(seen)
    assert shards("stage", corpus_pipeline.mix_sources(spark, docs, SF)) != shards("unmixed too", docs)
