"""Queries of geometry: the first three components of embeddings stand for points, label for the chain, vec_id div 250 for the complex."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from .registry import query, table

_POINTS = "(SELECT vec_id, vec_id // 250 AS complex, label AS chain, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_D = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


def _points(spark, d):
    axes = [F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")]
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 250).alias("complex"), F.col("label").alias("chain"), *axes)


@query("distance_join", f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_D}, 6) AS d FROM {_POINTS} a JOIN {_POINTS} b ON a.complex = b.complex AND a.chain < b.chain AND {_D} <= 0.05")
def distance_join(spark, d):
    p = _points(spark, d)
    near = G.grid_join(p, p, 0.05, ["complex"], condition=F.col("a_chain") < F.col("b_chain"))
    return near.select(F.col("a_vec_id").alias("id_a"), F.col("b_vec_id").alias("id_b"), F.round("d", 6).alias("d"))


@query("pair_combinations", f"WITH c AS (SELECT DISTINCT complex, chain FROM {_POINTS}) SELECT a.complex, a.chain AS key_a, b.chain AS key_b FROM c a JOIN c b ON a.complex = b.complex AND a.chain < b.chain")
def pair_combinations(spark, d):
    return G.pair_combinations(_points(spark, d), "chain", ["complex"])


@query("pair_interaction_class", f"""
WITH p AS {_POINTS}, c AS (SELECT complex, chain FROM p GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT a.complex, a.chain AS chain_a, b.chain AS chain_b, count(*) AS pairs FROM p a JOIN p b ON a.complex = b.complex AND a.chain < b.chain AND {_D} <= 0.04 GROUP BY ALL)
SELECT x.complex, x.chain AS chain_a, y.chain AS chain_b, coalesce(pairs, 0) AS pairs, CASE WHEN pairs >= 4 THEN 'interacting' WHEN pairs > 0 THEN 'too_few' ELSE 'non_interacting' END AS class
FROM c x JOIN c y ON x.complex = y.complex AND x.chain < y.chain LEFT JOIN n ON n.complex = x.complex AND n.chain_a = x.chain AND n.chain_b = y.chain
""")
def pair_interaction_class(spark, d):
    p = _points(spark, d)
    chains = p.groupBy("complex", "chain").agg(F.count("*").alias("length"), F.array_join(F.array_sort(F.collect_list("vec_id")), ",").alias("sequence"))
    return G.interaction_classes(p, chains, "complex", "chain", 0.04)


@query("running_offset", f"""
SELECT complex, chain, length, coalesce(sum(length + 200) OVER (PARTITION BY complex ORDER BY chain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM (SELECT complex, chain, count(*) AS length FROM {_POINTS} GROUP BY ALL)
""")
def running_offset(spark, d):
    chains = _points(spark, d).groupBy("complex", "chain").agg(F.count("*").alias("length"))
    return G.running_offsets(chains, "complex", "chain", "length", 200)


@query("topk_nearest", f"SELECT vec_id, round(sqrt(x * x + y * y + z * z), 6) AS d FROM {_POINTS} ORDER BY sqrt(x * x + y * y + z * z) + vec_id * 1e-9, vec_id LIMIT 64")
def topk_nearest(spark, d):
    near = G.nearest(_points(spark, d), (0, 0, 0), 64, "vec_id", 1e-9)
    return near.select("vec_id", F.round("d", 6).alias("d"))


@query("spatial_crop", f"""
WITH p AS {_POINTS}, near AS (
  SELECT DISTINCT a.*, ('0x' || substr(md5('0:' || a.chain || ':' || a.vec_id), 1, 8))::BIGINT AS h FROM p a JOIN p b ON a.complex = b.complex AND a.chain <> b.chain AND {_D} < 0.05
), place AS (SELECT complex, x, y, z FROM near QUALIFY row_number() OVER (PARTITION BY complex ORDER BY h, vec_id) = 1
), d AS (SELECT a.*, coalesce({_D}, 0) AS d FROM p a LEFT JOIN place b ON a.complex = b.complex)
SELECT vec_id, complex, chain, x, y, z FROM d QUALIFY row_number() OVER (PARTITION BY complex ORDER BY d, vec_id, chain) <= 40
""")
def spatial_crop(spark, d):
    return G.spatial_crop(_points(spark, d), "complex", "chain", "vec_id", 40, 0.05)


#: In the plane, the best rotation or reflection of centered points a and b has in closed form what Kabsch's method finds.
@query("superposition", f"""
WITH p AS (SELECT p.*, embedding[4]::DOUBLE * 0.1 AS e, embedding[5]::DOUBLE * 0.1 AS f FROM {_POINTS} p JOIN embeddings USING (vec_id)),
q AS (SELECT complex, x AS ax, y AS ay, -y + e + 1 AS bx, x + f - 2 AS b_y FROM p),
c AS (SELECT complex, ax - avg(ax) OVER w AS ax, ay - avg(ay) OVER w AS ay, bx - avg(bx) OVER w AS bx, b_y - avg(b_y) OVER w AS b_y FROM q WINDOW w AS (PARTITION BY complex))
SELECT complex, count(*) AS n, round(sqrt(greatest(0, sum(ax * ax + ay * ay + bx * bx + b_y * b_y) - 2 * greatest(
  sqrt(pow(sum(ax * bx + ay * b_y), 2) + pow(sum(ax * b_y - ay * bx), 2)), sqrt(pow(sum(ax * bx - ay * b_y), 2) + pow(sum(ax * b_y + ay * bx), 2)))) / count(*)), 6) AS rmsd
FROM c GROUP BY complex
""")
def superposition(spark, d):
    noise = table(spark, d, "embeddings").select("vec_id", *[(F.get("embedding", 3 + i).cast("double") * 0.1).alias(c) for i, c in enumerate("ef")])
    p = _points(spark, d).withColumn("z", F.lit(0.0))
    turned = p.join(noise, "vec_id").withColumns({"x": -F.col("y") + F.col("e") + 1, "y": F.col("x") + F.col("f") - 2})
    fits = G.superpose(p, turned, "complex", "vec_id")
    return fits.select("complex", "n", F.round("rmsd", 6).alias("rmsd"))
