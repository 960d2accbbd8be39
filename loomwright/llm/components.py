"""Connected components by contraction: every step is a join or an aggregation of staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): label is the smallest node that can be reached.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by repeated
    squaring, and contracts the graph onto these ends. At least half of the nodes of a component vanish in a
    round, so the number of rounds is logarithmic. Nodes may be of any type that has an order; edges with a
    null end and self-loops are ignored. Nothing is collected: hub nodes meet plain scans in joins, which
    adaptive execution splits, and aggregations with partial sums.
    """
    clean = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    graph = stage(clean.union(clean.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = None
    while not graph.isEmpty():
        parent = stage(graph.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parent")
        while True:
            above = parent.select(F.col("u").alias("p"), F.col("p").alias("top"))
            jumped = stage(parent.join(above, "p").select("u", F.col("top").alias("p"), (F.col("p") != F.col("top")).alias("moved")), "jump")
            settled = jumped.where("moved").isEmpty()
            parent = jumped.select("u", "p")
            if settled:
                break
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            step = parent.select(F.col("u").alias("label"), F.col("p").alias("to"))
            labels = stage(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = parent.select("u", F.col("p").alias("pu"))
        half = stage(graph.join(ends, "u").select("pu", "v"), "half")
        other = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        graph = stage(half.join(other, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    if labels is None:
        labels = graph.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
