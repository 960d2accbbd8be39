import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomwright.llm import multiindex

SF = "/root/testdata/sf0.1"


def brute(rows, every, k=10):
    """{(query, vector): [(distance, id)]} of all candidates, nearest first."""
    vs = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in vs), default=0)
    vs = [(i, tuple(v) + (0.0,) * (width - len(v))) for i, v in vs]
    return {(q, a): sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, v, strict=True))), i) for i, v in vs if i != q)[:k] for q, a in vs if q % every == 0}


def found(df):
    out = {}
    for q, r, i, s in sorted(map(tuple, df.collect())):
        out.setdefault(q, []).append((s, i, r))
    return out


def test_recall_and_scores_on_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    want = {q: v for (q, _), v in brute([(r[0], list(r[1])) for r in table.collect()], 100).items()}
    got = found(multiindex.op13(spark, SF))
    assert got.keys() == want.keys()
    hit = 0
    for q, rows in got.items():
        assert [r for _, _, r in rows] == list(range(1, 11)) and rows == sorted(rows)
        true = dict((i, d) for d, i in want[q])
        assert all(math.isclose(true.get(i, s), s, rel_tol=1e-12) for s, i, _ in rows)
        hit += len(true.keys() & {i for _, i, _ in rows})
    assert hit >= 0.9 * 10 * len(want)


def test_recall_with_clusters_reads_few_cells(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16)) * 3
    rows = [(i, (middles[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = multiindex.MultiIndex(multiindex.real_vectors(df), block_rows=64, shard_blocks=20)
    assert index.shards > 1 and index.number_to_meet < 0.1 * len(rows)
    want, got = {q: v for (q, _), v in brute(rows, 100).items()}, found(index.search(F.col("vec_id") % 100 == 0, batch_rows=8))
    hit = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)


def test_all_cells_are_exact_on_odd_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5 if i % 9 else 3)]) for i in range(120)]
    rows += [(500 + i, rows[5][1]) for i in range(40)] + [(600, None), (605, [None, 1.0]), (610, [math.nan]), (615, [math.inf, 0.0]), (620, []), (625, [0.0, 0.0]), (None, [1.0]), (700, rows[9][1]), (700, rows[9][1])]
    for chosen, k in ((rows, 10), (rows, 3), (rows[:4], 10), (rows[120:161], 10)):
        df = spark.createDataFrame([(i, v, 3, 1.0) for i, v in chosen], "vec_id long, embedding array<double>, cell int, score double")
        index = multiindex.MultiIndex(multiindex.real_vectors(df), k=k, share=1.0, block_rows=16, shard_blocks=2)
        index.number_to_meet = 10**9
        want = {q: [(round(d, 12), i) for d, i in v] for (q, _), v in brute(chosen, 5, k).items()}  # sum() of Python corrects its rounding
        assert {q: [(round(s, 12), i) for s, i, _ in v] for q, v in found(index.search(F.col("vec_id") % 5 == 0, batch_rows=8)).items()} == {q: v for q, v in want.items() if v}


def test_short_searches_go_on_and_empty_tables(spark):
    rows = [(i, [float(i), float(i % 3 + 1)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = multiindex.MultiIndex(multiindex.real_vectors(df), block_rows=4)
    index.number_to_meet = 1
    got = found(index.search(F.col("vec_id") % 7 == 0))
    assert {q: [(round(s, 12), i) for s, i, _ in v] for q, v in got.items()} == {q: [(round(d, 12), i) for d, i in v] for (q, _), v in brute(rows, 7).items()}
    assert index.search(F.lit(False)).count() == 0
    assert multiindex.MultiIndex(multiindex.real_vectors(df.limit(0))).search(F.lit(True)).count() == 0


def test_heap_goes_through_cells_by_rising_sum():
    rng = np.random.default_rng(1)
    first, second, filled = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
    sums = np.add.outer(first, second)
    order = np.argsort(sums, axis=None)
    met = np.cumsum(filled.ravel()[order])
    for number in (1, 5, 40, int(met[-1])):
        want = sums.ravel()[order][np.searchsorted(met, number)]
        assert abs(multiindex.reach(first, second, filled, number) - want) < 1e-6
    assert multiindex.reach(first, second, filled, met[-1] + 1) == math.inf
