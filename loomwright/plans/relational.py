"""Queries of filters, joins, unions and deduplication; lineitem, part and supplier stand for pairs and their entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, random, sequences
from ..operators import relational as R
from ..operators.ordinals import number_in_groups
from .registry import query, table

_PAIRS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice"
_HASH = "('0x' || substr(md5('{salt}:' || {key}), 1, 8))::BIGINT"
_SPLIT = f"CASE WHEN {_HASH.format(salt='split', key='o_orderkey')} % 10 < 7 THEN 'train' WHEN {_HASH.format(salt='split', key='o_orderkey')} % 10 < 9 THEN 'val' ELSE 'test' END"


def _splits(spark, d):
    u = F.pmod(random.hash_number("split", F.col("o_orderkey")), F.lit(10))
    return table(spark, d, "orders").select("o_orderkey", F.when(u < 7, "train").when(u < 9, "val").otherwise("test").alias("split"))


@query("star_join", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice AS activity_value, l_returnflag AS activity_label, p_name AS ligand, p_type, s_name AS target, s_acctbal
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'R')
""")
def star_join(spark, d):
    facts = R.keep_or_exclude(table(spark, d, "lineitem").selectExpr(*_PAIRS.split(", ")), {"l_returnflag": {"mode": "keep", "values": ["A", "R"]}})
    joined = R.star_join(facts, {"ligands": (table(spark, d, "part"), "l_partkey", "p_partkey"), "targets": (table(spark, d, "supplier"), "l_suppkey", "s_suppkey")})
    return joined.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("activity_value"), F.col("l_returnflag").alias("activity_label"), F.col("p_name").alias("ligand"), "p_type", F.col("s_name").alias("target"), "s_acctbal")


@query("project_rename", "SELECT l_orderkey AS activity_id, l_partkey AS ligand_id, l_extendedprice AS activity_value FROM lineitem")
def project_rename(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").withColumnsRenamed({"l_orderkey": "activity_id", "l_partkey": "ligand_id", "l_extendedprice": "activity_value"})


@query("filter_keep", f"SELECT {_PAIRS} FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linenumber IN (1, 2, 3)")
def filter_keep(spark, d):
    rules = {"l_returnflag": {"mode": "keep", "values": ["A", "N"]}, "l_linenumber": {"mode": "keep", "values": [1, 2, 3]}}
    return R.keep_or_exclude(table(spark, d, "lineitem").selectExpr(*_PAIRS.split(", ")), rules)


@query("filter_exclude_nulls", "SELECT doc_id, toxic FROM (SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)) WHERE toxic IS NULL OR toxic NOT IN (1)")
def filter_exclude_nulls(spark, d):
    labelled = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return R.keep_or_exclude(labelled, {"toxic": {"mode": "exclude", "values": [1]}})


@query("fold_select", f"SELECT o_orderkey, split FROM (SELECT o_orderkey, {_SPLIT} AS split FROM orders) WHERE split IN ('train', 'val')")
def fold_select(spark, d):
    return R.select_folds(_splits(spark, d), ["train", "val"])


@query("require_non_null", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def require_non_null(spark, d):
    labelled = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.require_non_null(labelled, ["quality", "absent"])


@query("join_composite", f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_returnflag, r.l_returnflag AS l_returnflag_split_duplicate, r.split
FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(CASE WHEN {_HASH.format(salt='fold', key="l_orderkey || ':' || l_linenumber")} % 5 = 0 THEN 'test' ELSE 'train' END) AS split FROM lineitem GROUP BY ALL) r
ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber
""")
def join_composite(spark, d):
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    keys = ["l_orderkey", "l_linenumber"]
    fold = F.when(F.pmod(random.hash_number("fold", *[F.col(k) for k in keys]), F.lit(5)) == 0, "test").otherwise("train")
    splits = pairs.groupBy(*keys).agg(F.max("l_returnflag").alias("l_returnflag")).withColumn("split", fold)
    return R.join_composite(pairs, splits, keys)


@query("semi_join", f"SELECT {_PAIRS} FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def semi_join(spark, d):
    facts = table(spark, d, "lineitem").selectExpr(*_PAIRS.split(", "))
    known = R.only_known(facts, table(spark, d, "part").where("p_size > 25"), "l_partkey", "p_partkey")
    return R.only_known(known, table(spark, d, "supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey")


_LAST = "l_orderkey = (SELECT max(l_orderkey) FROM lineitem)"


@query("lookup_composite_key", f"SELECT {_PAIRS} FROM lineitem WHERE {_LAST} AND l_linenumber = (SELECT max(l_linenumber) FROM lineitem WHERE {_LAST})")
def lookup_composite_key(spark, d):
    facts = table(spark, d, "lineitem").selectExpr(*_PAIRS.split(", "))
    last = facts.agg(F.max(F.struct("l_orderkey", "l_linenumber")).alias("k"))
    return facts.where((F.col("l_orderkey") == last.select("k.l_orderkey").scalar()) & (F.col("l_linenumber") == last.select("k.l_linenumber").scalar()))


@query("load_by_key", "SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def load_by_key(spark, d):
    samples = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.load_by_key(samples, table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "l_partkey", "p_partkey")


@query("lookup_by_id", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 57")
def lookup_by_id(spark, d):
    return table(spark, d, "part").where("p_partkey = 57").select("p_partkey", "p_name")


@query("lookup_first_wins", "SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def lookup_first_wins(spark, d):
    return R.first_wins(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], ["p_partkey"])


@query("get_single", "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_7'")
def get_single(spark, d):
    return R.get_single(table(spark, d, "nation").select("n_nationkey", "n_name"), n_name="NATION_7")


@query("cond_pipeline", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_extendedprice * 0.5 ELSE l_extendedprice END AS value, 'tpch' AS origin FROM lineitem")
def cond_pipeline(spark, d):
    value = F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice") * 0.5).otherwise(F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"), F.lit("tpch").alias("origin"))


@query("label_lookup", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 WHEN 'R' THEN -1 END AS label FROM lineitem")
def label_lookup(spark, d):
    known = sequences.lookup({"A": 1, "N": 0, "R": -1})
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(known, F.col("l_returnflag")).alias("label"))


@query("filter_known_label", "SELECT doc_id, label FROM (SELECT doc_id, coalesce(toxic, -1) AS label FROM documents LEFT JOIN labels USING (doc_id)) WHERE label >= 0")
def filter_known_label(spark, d):
    labelled = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return labelled.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("label")).where("label >= 0")


@query("valid_sequence", "SELECT p_partkey, seq FROM (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS seq FROM part) WHERE regexp_matches(seq, '^[ACDEFGHIKLMNPQRSTVWY]+$') AND length(seq) <= 50")
def valid_sequence(spark, d):
    return table(spark, d, "part").select("p_partkey", sequences.normalise(F.col("p_name")).alias("seq")).where(sequences.is_valid(F.col("seq"), 50))


@query("ordinal_then_filter", "SELECT o_custkey, o_orderkey, ordinal FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders) WHERE o_orderstatus = 'F'")
def ordinal_then_filter(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return number_in_groups(orders, "o_custkey", ["o_orderkey"]).where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "ordinal")


@query("dominant_share_filter", "SELECT o_custkey, sum(n)::BIGINT AS rows, round(max(n) / sum(n), 9) AS share FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey HAVING sum(n) >= 8 AND max(n) / sum(n) <= 0.5")
def dominant_share_filter(spark, d):
    return R.dominant_share(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus").withColumn("share", F.round("share", 9))


@query("affinity_log_transform", "SELECT l_orderkey, l_linenumber, round(-log10(v * 1e-9), 6) AS affinity FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS v FROM lineitem) WHERE v > 0 AND v <= 60000")
def affinity_log_transform(spark, d):
    text = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "<").otherwise(">"), F.round("l_extendedprice", 2).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(labels.affinity(text, 60000), 6).alias("affinity")).where("affinity is not null")


@query("dedup_first_wins", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_wins(spark, d):
    return R.first_wins(table(spark, d, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"]).select("doc_id", "source")


@query("priority_union", """
WITH u AS (
  SELECT 0 AS rank, 'benchmark' AS source, item_id AS id, text, NULL AS lang FROM benchmark
  UNION ALL SELECT 1, 'documents', doc_id, text, lang FROM documents
  UNION ALL SELECT 2, 'conversations', conv_id * 1000 + turn, text, NULL FROM conversations
)
SELECT source, id, lang, source = 'benchmark' AS benchmark, source = 'documents' AS documents, source = 'conversations' AS conversations
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY rank, id) AS n FROM u) WHERE n = 1
""")
def priority_union(spark, d):
    sources = {
        "benchmark": table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"),
        "documents": table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"),
        "conversations": table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"),
    }
    return R.priority_union(sources, "text", ["id"]).drop("text")


@query("distinct_values", "SELECT DISTINCT p_name FROM part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_name").distinct()


@query("distinct_apply", "SELECT p_partkey, length(p_name)::BIGINT AS feature FROM part")
def distinct_apply(spark, d):
    lengths = lambda v: v.select("p_name", F.length("p_name").cast("long").alias("feature"))
    return R.on_distinct(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", lengths, "feature").select("p_partkey", "feature")


@query("indices_per_class", "SELECT l_returnflag AS label, count(*) AS n, min(i) AS first, max(i) AS last, sum(i)::BIGINT AS total FROM (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS i FROM lineitem) GROUP BY ALL")
def indices_per_class(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))
    return R.indices_per_class(rows, "label", "i").groupBy("label").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"), F.sum("i").alias("total"))


@query("label_stats", f"SELECT split, l_returnflag AS label, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey, {_SPLIT} AS split FROM orders) ON l_orderkey = o_orderkey GROUP BY ALL")
def label_stats(spark, d):
    return table(spark, d, "lineitem").join(_splits(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("split", F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"))


@query("sort_ids", "SELECT label AS center, vec_id AS id FROM embeddings ORDER BY id")
def sort_ids(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("center"), F.col("vec_id").alias("id")).orderBy("id")


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("nested_min_max", "SELECT user_id, min(k) AS least, max(k) AS most FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY user_id")
def nested_min_max(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("user_id").agg(F.min(k).alias("least"), F.max(k).alias("most"))


@query("unpivot_avg", "SELECT s_nationkey, metric, round(avg(value), 6) AS mean FROM (SELECT s_nationkey, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_nationkey, 'key', s_suppkey::DOUBLE FROM supplier) GROUP BY ALL")
def unpivot_avg(spark, d):
    wide = table(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("balance"), F.col("s_suppkey").cast("double").alias("key"))
    return wide.unpivot("s_nationkey", ["balance", "key"], "metric", "value").groupBy("s_nationkey", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))
