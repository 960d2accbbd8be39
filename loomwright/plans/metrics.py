"""Queries of classifier, sequence and vector metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from .registry import query, table


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


_STEPS = """
WITH s AS (SELECT n_chars::DOUBLE AS score, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC))
"""


@query("auroc", _STEPS + "SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 9) AS auroc FROM c")
def auroc(spark, d):
    return M.auroc(_scored(spark, d), "score", "toxic").select(F.round("auroc", 9).alias("auroc"))


@query("aupr", _STEPS + "SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS aupr FROM c")
def aupr(spark, d):
    return M.average_precision(_scored(spark, d), "score", "toxic").select(F.round("aupr", 9).alias("aupr"))


@query("roc_points", _STEPS + "SELECT score AS threshold, round(tp / (SELECT sum(pos) FROM s), 9) AS tpr, round(fp / (SELECT sum(neg) FROM s), 9) AS fpr FROM c")
def roc_points(spark, d):
    return M.roc_points(_scored(spark, d), "score", "toxic").select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("threshold_accuracy", "SELECT round(avg(CASE WHEN (n_chars > 2000) = (toxic = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id)")
def threshold_accuracy(spark, d):
    right = F.when((F.col("score") > 2000) == (F.col("toxic") == 1), 1.0).otherwise(0.0)
    return _scored(spark, d).agg(F.round(F.avg(right), 9).alias("accuracy"), F.count("*").alias("n"))


def _pairs(spark, d):
    """Each part's name beside the previous part's."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    return parts.join(parts.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


_PAIRS = "(SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey + 1 = x.p_partkey)"
_SAME = "len([i FOR i IN range(1, least(length(a), length(b)) + 1) IF a[i] = b[i]])"


@query("aar", f"SELECT p_partkey, round({_SAME} / length(a), 9) AS recovery FROM {_PAIRS} WHERE length(a) = length(b)")
def aar(spark, d):
    same = _pairs(spark, d).where(F.length("a") == F.length("b"))
    return same.select("p_partkey", F.round(M.recovery(F.col("a"), F.col("b")), 9).alias("recovery"))


@query("seq_accuracy", f"SELECT round(avg({_SAME} / length(b)), 9) AS accuracy FROM {_PAIRS}")
def seq_accuracy(spark, d):
    return _pairs(spark, d).agg(F.round(F.avg(M.accuracy(F.col("a"), F.col("b"))), 9).alias("accuracy"))


#: The longest common stretch, the earliest of these, then the same to its left and right; what lies between two stretches is replaced, inserted or deleted.
@query("edit_opcodes", f"""
WITH RECURSIVE p AS {_PAIRS}, e AS (
  SELECT p_partkey, i, j, max(i) OVER (PARTITION BY p_partkey, i - j, island) - i + 1 AS run FROM (
    SELECT *, i - row_number() OVER (PARTITION BY p_partkey, i - j ORDER BY i) AS island FROM (
      SELECT p_partkey, a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM p)) WHERE a[i] = b[j])
), w AS (
  SELECT p_partkey, 1::BIGINT AS a0, length(a) AS a1, 1::BIGINT AS b0, length(b) AS b1, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::BIGINT AS size FROM p
  UNION ALL
  SELECT p_partkey, unnest([m.a0, m.i + m.size, NULL]), unnest([m.i - 1, m.a1, NULL]), unnest([m.b0, m.j + m.size, NULL]), unnest([m.j - 1, m.b1, NULL]), unnest([NULL, NULL, m.i]), unnest([NULL, NULL, m.j]), unnest([NULL, NULL, m.size]) FROM (
    SELECT *, -struct_extract(best, 'i') AS i, -struct_extract(best, 'j') AS j, struct_extract(best, 'size') AS size FROM (
      SELECT w.p_partkey, w.a0, w.a1, w.b0, w.b1, max({{'size': least(e.run, w.a1 - e.i + 1, w.b1 - e.j + 1), 'i': -e.i, 'j': -e.j}}) AS best
      FROM w JOIN e ON e.p_partkey = w.p_partkey AND e.i BETWEEN w.a0 AND w.a1 AND e.j BETWEEN w.b0 AND w.b1 GROUP BY ALL
    )
  ) m
), met AS (
  SELECT p_partkey, i, j, size FROM w WHERE i IS NOT NULL UNION ALL SELECT p_partkey, length(a) + 1, length(b) + 1, 0 FROM p
), gaps AS (
  SELECT p_partkey, size, i - coalesce(lag(i + size) OVER o, 1) AS x, j - coalesce(lag(j + size) OVER o, 1) AS y FROM met WINDOW o AS (PARTITION BY p_partkey ORDER BY i, j)
)
SELECT *, CASE WHEN "insert" + "delete" + "replace" + "equal" > 0 THEN "equal" / ("insert" + "delete" + "replace" + "equal") ELSE 0.0 END AS score FROM (
  SELECT p_partkey, sum(y - least(x, y))::BIGINT AS "insert", sum(x - least(x, y))::BIGINT AS "delete", sum(least(x, y))::BIGINT AS "replace", sum(size)::BIGINT AS "equal" FROM gaps GROUP BY p_partkey)
""")
def edit_opcodes(spark, d):
    counted = _pairs(spark, d).select("p_partkey", M.edit_opcodes("a", "b").alias("c"))
    return counted.select("p_partkey", "c.*", M.aligned_score(F.col("c")).alias("score"))


@query("alignment_score", f"""
WITH RECURSIVE r AS (
  SELECT p_partkey, a, b, 0 AS i, [-j FOR j IN range(length(b) + 1)] AS best FROM {_PAIRS}
  UNION ALL
  SELECT p_partkey, a, b, i + 1, [list_max([t[k + 1] + k FOR k IN range(j + 1)]) - j FOR j IN range(length(b) + 1)] FROM (
    SELECT *, [CASE WHEN j = 0 THEN -(i + 1) ELSE greatest(best[j] + CASE WHEN a[i + 1] = b[j] THEN 1 ELSE -1 END, best[j + 1] - 1) END FOR j IN range(length(b) + 1)] AS t FROM r WHERE i < length(a)
  )
)
SELECT p_partkey, best[-1]::DOUBLE AS score FROM r WHERE i = length(a)
""")
def alignment_score(spark, d):
    score = M.alignment_scorer(match=1.0, mismatch=-1.0, gap=-1.0)
    return _pairs(spark, d).select("p_partkey", score("a", "b").alias("score"))


@query("vector_distances", """
SELECT x.vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS cosine,
  round(list_distance(a, b), 6) AS euclidean, round(pow(list_distance(a, b), 2), 6) AS euclidean_squared
FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) x JOIN (SELECT vec_id + 1 AS vec_id, embedding::DOUBLE[] AS b FROM embeddings) y ON x.vec_id = y.vec_id
""")
def vector_distances(spark, d):
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select("vec_id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.euclidean(a, b), 6).alias("euclidean"), F.round(V.euclidean_squared(a, b), 6).alias("euclidean_squared"))


@query("gaussian_kl", "SELECT vec_id, round(list_sum([0.5 * (exp(v) - v - 1) FOR v IN embedding::DOUBLE[]]), 6) AS kl FROM embeddings")
def gaussian_kl(spark, d):
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.gaussian_kl(doubles), 6).alias("kl"))
