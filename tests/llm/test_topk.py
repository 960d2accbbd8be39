import math
import random

import duckdb
from pyspark.sql import functions as F

from loomwright.llm import topk

SF = "/root/testdata/sf0.01"


def brute(rows, every=5, k=5):
    vs = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in vs if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in vs if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_embeddings_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(duckdb.sql(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP10_SQL})").fetchall())
    assert sorted(map(tuple, topk.op10(spark, SF).collect())) == want and len(want) == 50


def test_odd_vectors(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(6 if i % 9 else 4)]) for i in range(120)]
    rows += [(500 + i, rows[3][1]) for i in range(20)] + [(600, None), (605, [None, 1.0]), (610, [math.nan]), (615, [math.inf, 0.0]), (620, []), (None, [1.0]), (700, rows[9][1]), (700, rows[9][1]), (700, rows[8][1])]
    for chosen, k, head in ((rows, 5, 16), (rows, 3, 2048), (rows[:3], 5, 4), (rows[120:121], 5, 4)):
        df = spark.createDataFrame([(i, v, 1) for i, v in chosen], "vec_id long, embedding array<double>, v int")
        got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 5 == 0, k=k, head_rows=head, head_dims=2, block_rows=16)
        assert sorted(map(tuple, got.collect())) == brute(chosen, 5, k)
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("vec_id") % 5 == 0).count() == 0


def test_large_components(spark):
    rows = [(i, [float(10**6 * (i + 1)), float(3 - i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 5 == 0).collect())) == brute(rows)
