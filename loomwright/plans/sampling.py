"""Queries of splits, weights, minibatches and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C, relational as R, sampling as S
from .registry import query, table

_U = "('0x' || substr(md5('{salt}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_SETS = {"train": 0.7, "val": 0.2, "test": 0.1}
_PICK = "CASE WHEN u <= 0.7::DOUBLE THEN 'train' WHEN u <= 0.7::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END"


@query("cluster_split", f"SELECT o_custkey, o_orderkey, {_PICK} AS set FROM (SELECT o_custkey, o_orderkey, {_U.format(salt='7', key='o_custkey')} AS u FROM orders)")
def cluster_split(spark, d):
    return S.cluster_split(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", _SETS, 7)


@query("split_summary", f"SELECT set, count(*) AS members, count(DISTINCT o_custkey) AS centers FROM (SELECT o_custkey, {_PICK} AS set FROM (SELECT o_custkey, {_U.format(salt='7', key='o_custkey')} AS u FROM orders)) GROUP BY set")
def split_summary(spark, d):
    return S.split_summary(cluster_split(spark, d), "o_custkey")


@query("split_cold_entity", f"SELECT l_orderkey, l_linenumber, l_partkey, {_PICK} AS set FROM (SELECT *, {_U.format(salt='cold', key='l_partkey')} AS u FROM lineitem)")
def split_cold_entity(spark, d):
    return S.cluster_split(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", _SETS, "cold")


@query("split_temporal", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'val' ELSE 'test' END AS set FROM orders")
def split_temporal(spark, d):
    return S.temporal_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", {"train": "1997-01-01", "val": "1999-01-01"}, "test").drop("o_orderdate")


@query("cluster_sizes", "SELECT label AS center, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("center")).agg(F.count("*").alias("n"))


@query("inverse_cluster_weight", """
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o.o_custkey, o.o_orderkey, round((1.0::DOUBLE / n) / (SELECT sum(1.0::DOUBLE / n) FROM s), 12) AS inverse_balance_proportion FROM orders o JOIN s ON o.o_custkey = s.o_custkey
""")
def inverse_cluster_weight(spark, d):
    out = S.inverse_cluster_weights(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey")
    return out.withColumn("inverse_balance_proportion", F.round("inverse_balance_proportion", 12))


@query("kfold_assign", "SELECT o_orderkey, ((row_number() OVER (ORDER BY ('0x' || substr(md5('2580:' || o_orderkey), 1, 8))::BIGINT, o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders")
def kfold_assign(spark, d):
    return S.fold_of_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("balanced_minibatches", """
WITH n AS (SELECT (SELECT count(*) FROM supplier) AS a, (SELECT count(*) FROM customer) AS b, (SELECT count(*) FROM nation) AS c),
slots AS (SELECT * FROM (VALUES (0, 0, 0, 3), (1, 0, 1, 3), (2, 0, 2, 3), (3, 1, 0, 2), (4, 1, 1, 2), (5, 2, 0, 1)) t(slot, dataset, s, k)),
m AS (SELECT unnest(range(greatest(ceil(a / 3), ceil(b / 2), c)::BIGINT)) AS minibatch_id FROM n)
SELECT minibatch_id, slot::BIGINT AS slot, dataset::BIGINT AS dataset,
  CASE dataset WHEN 0 THEN (minibatch_id * k + s) % a WHEN 1 THEN a + (minibatch_id * k + s) % b ELSE a + b + (minibatch_id * k + s) % c END AS sample_id
FROM m, slots, n
""")
def balanced_minibatches(spark, d):
    lengths = [table(spark, d, t).count() for t in ("supplier", "customer", "nation")]
    return S.concat_batches(spark, lengths, [3, 2, 1])


@query("balanced_class_batches", """
WITH r AS (SELECT toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels),
slots AS (SELECT * FROM (VALUES (0, 0, 0, 3), (1, 0, 1, 3), (2, 0, 2, 3), (3, 1, 0, 2), (4, 1, 1, 2)) t(slot, c, s, k)),
m AS (SELECT unnest(range(ceil(min(n) / min_by(k, (n, toxic)))::BIGINT)) AS minibatch_id FROM r JOIN slots ON c = toxic)
SELECT minibatch_id, slot::BIGINT AS slot, toxic, doc_id FROM m, slots JOIN r ON r.toxic = c AND r.i = (minibatch_id * k + s) % n
""")
def balanced_class_batches(spark, d):
    return S.class_batches(table(spark, d, "labels"), "toxic", "doc_id", {0: 3, 1: 2})


@query("subset_window", """
WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, source FROM d WHERE i // 100 = 2 % ((n + 99) // 100)
""")
def subset_window(spark, d):
    return S.subset_window(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, 2)


@query("weighted_classes", """
WITH n AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IN (0, 1) GROUP BY toxic), s AS (SELECT min(n / 0.5::DOUBLE) AS scale FROM n)
SELECT l.* FROM labels l JOIN n ON l.toxic = n.toxic, s WHERE ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1, scale * 0.5::DOUBLE / n)
""")
def weighted_classes(spark, d):
    return S.weighted_classes(table(spark, d, "labels"), "toxic", {0: 0.5, 1: 0.5}, "doc_id")


@query("exact_dedup_clusters", "SELECT min(doc_id) OVER (PARTITION BY text) AS center, doc_id AS id FROM documents WHERE text IS NOT NULL")
def exact_dedup_clusters(spark, d):
    return C.exact_clusters(table(spark, d, "documents"), "doc_id", "text")


@query("kmer_clusters")
def kmer_clusters(spark, d):
    return C.kmer_clusters(table(spark, d, "part"), "p_partkey", "p_name", k=4)


@query("gapped_clusters")
def gapped_clusters(spark, d):
    """Names that are alike but for single letters put in or left out, on both sides."""
    return C.kmer_clusters(table(spark, d, "part"), "p_partkey", "p_name", k=4, coverage=0.8, band=8)


@query("kmer_features", """
WITH k AS (SELECT p_partkey, p_name, [('0x' || substr(md5(substr(p_name, i, 3)), 1, 8))::BIGINT % 64 FOR i IN range(1, length(p_name) - 1)] AS hs FROM part)
SELECT p_partkey, p_name, array_to_string([len([x FOR x IN hs IF x = j]) FOR j IN range(64)], ',') AS vector FROM k
""")
def kmer_features(spark, d):
    out = C.kmer_features(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")
    return out.withColumn("vector", F.array_join(F.transform("vector", lambda x: x.cast("int")), ","))


@query("dedup_by_sequence", "SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name")
def dedup_by_sequence(spark, d):
    return R.first_wins(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name"], ["p_partkey"])
