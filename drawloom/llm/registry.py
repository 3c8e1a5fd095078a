"""Queries opN_<name> of the corpus operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, embeddings, jaccard, mixing, packing, quality, repeats, resample, secrets, sharding, token_counts,
    toxicity, whitening,
)
from .common import table
from .labelled import held_out


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep_bytes=False).drop("kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels"), held=held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Targets: square roots of the sources' characters, so long texts weigh more than many.
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.col("n_chars"), F.lit(0)) + 1).alias("_chars"))
    return mixing.report(docs, weights=sizes.select("source", F.sqrt("_chars").alias("weight")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, owner="source", repo=F.concat_ws("/", "source", "lang"))


def op5_toxicity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held=held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90, count=True)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents"))))


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), window=2048)


def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample.resample(docs, benchmark, percent=25, least_words=20, seed=7)


QUERIES = (
    op1_suffix_array_dedup, op2_quality_classifier, op3_pfair_mixing, op4_secret_scan, op5_toxicity_classifier,
    op6_benchmark_decontamination, op7_ngram_jaccard_join, op8_embedding_near_dedup, op9_label_propagation_shards,
    op10_token_counts, op11_mixture_packing, op12_svd_whitening, op13_importance_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP8_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM usable),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.93e0),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


OP7_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
lists AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sets AS (SELECT doc_id, len(s) AS n, s FROM lists),
each AS (SELECT doc_id, n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS shared FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 90 * (total - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM sets JOIN least ON least.a = doc_id LEFT JOIN counts ON counts.a = doc_id
"""


OP6_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT *, least(10, len(w)) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (SELECT item, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM items, range(1, len(w) - n + 2) AS r(p)),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM docs, (SELECT DISTINCT n FROM items) AS lengths, range(1, greatest(len(w) - n + 2, 1)) AS r(i)),
hits AS (SELECT doc_id, n, i, item, p FROM doc_windows JOIN item_windows USING (n, s)),
words AS (SELECT DISTINCT doc_id, i + k - 1 AS x FROM hits, range(n) AS r(k)),
runs AS (SELECT doc_id, min(x) AS a, max(x) + 1 AS b FROM (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS g FROM words) GROUP BY doc_id, g),
spans AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_hit, string_agg(a || ',' || b, ',' ORDER BY a) AS hit_spans FROM runs GROUP BY doc_id),
item_words AS (SELECT k, p, w[p] AS x FROM (SELECT row_number() OVER () AS k, w FROM items) AS l, range(1, len(w) + 1) AS r(p)),
doc_words AS (SELECT doc_id, i, w[i] AS x FROM docs, range(1, len(w) + 1) AS r(i)),
same_words AS (SELECT doc_id, k, i, i - p AS diagonal FROM doc_words JOIN item_words USING (x)),
matches AS (SELECT doc_id, count(*) AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, k, diagonal ORDER BY i) AS g FROM same_words) GROUP BY doc_id, k, diagonal, g),
longest AS (SELECT doc_id, CAST(max(words) AS BIGINT) AS longest_match FROM matches GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest_match, 0) AS longest_match, coalesce(hit_spans, '') AS hit_spans
FROM docs LEFT JOIN spans USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN named USING (doc_id)
"""


# DuckDB has no crc32: each different feature's sum is folded over its bytes, with the table that the polynomial gives.
OP13_SQL = r"""
WITH words AS (SELECT corpus, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT 'source' AS corpus, doc_id AS id, text FROM documents UNION ALL SELECT 'target', NULL, text FROM benchmark)),
features AS (SELECT corpus, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
counts AS (SELECT corpus, id, f, count(*) AS n FROM features GROUP BY ALL),
crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
hashed AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM counts), crc),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 'source'), 0) AS s, coalesce(sum(n) FILTER (corpus = 'target'), 0) AS t FROM counts JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM counts JOIN hashed USING (f) JOIN gains USING (bucket) WHERE corpus = 'source' GROUP BY id),
scored AS (SELECT d.id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM (SELECT * FROM words WHERE corpus = 'source') d LEFT JOIN weights USING (id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_benchmark_decontamination": OP6_SQL, "op7_ngram_jaccard_join": OP7_SQL,
        "op8_embedding_near_dedup": OP8_SQL, "op13_importance_resampling": OP13_SQL,
    }
