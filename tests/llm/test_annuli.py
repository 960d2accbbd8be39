import math
import random

import duckdb
from pyspark.sql import functions as F

from loomwright.llm import annuli

SF = "/root/testdata/sf0.01"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=4, positives=5, negatives=10):
    most = 2**63 - 1
    vs = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, q in {(i, lab, tuple(v)) for i, lab, v in vs if i % every == 0}:
        scored = sorted((-max(-most, min(most, sum(x * y for x, y in zip(q, v, strict=False)))), i, c == lab) for i, c, v in vs if i != a)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fit = [(n, i) for n, i, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit[:negatives])]
    return sorted(out)


def test_embeddings_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(duckdb.sql(f"SELECT {', '.join(COLS)} FROM ({annuli.OP12_SQL})").fetchall())
    assert sorted(map(tuple, annuli.op12(spark, SF).select(*COLS).collect())) == want and len(want) == 250


def test_odd_vectors_small_blocks_and_shards(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(6 if i % 9 else 4)], i % 3) for i in range(150)]
    rows += [(500 + i, rows[8][1], i % 2) for i in range(40)]
    rows += [(700, None, 1), (704, [None, 1.0], 1), (708, [math.nan], 1), (712, [math.inf], 1), (716, [], 1), (720, [0.0], 2), (None, [1.0], 1), (724, [1.0], None)]
    rows += [(8, rows[8][1], 2), (8, rows[8][1], 2), (8, rows[9][1], 0), (1, rows[4][1], 1)]
    for chosen, scale, pivots, blocks in ((rows, 1, 7, 16), (rows, 1e8, 3, 64), (rows[:3], 1, 64, 4096), (rows[150:], 1, 2, 8)):
        chosen = [(i, v and [None if x is None else x * scale for x in v], lab) for i, v, lab in chosen]
        df = spark.createDataFrame([(*r, 1, 2.0) for r in chosen], "vec_id long, embedding array<double>, label int, pivot int, key double")
        store = annuli.Annuli(annuli.labelled_vectors(df), pivots=pivots, sample_rows=50, block_rows=blocks, shard_blocks=3)
        got = store.mine(F.col("vec_id") % 4 == 0, batch_rows=10)
        assert sorted(map(tuple, got.select(*COLS).collect())) == brute(chosen)
    assert store.mine(F.lit(False)).count() == 0
    assert annuli.Annuli(annuli.labelled_vectors(df.limit(0))).mine(F.lit(True)).count() == 0


def test_a_part_of_the_blocks_is_read(spark):
    """In clusters far apart, an anchor's scan ends before it has read all blocks."""
    rng = random.Random(2)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [10 * m / math.hypot(*middles[i % 20]) + rng.gauss(0, 0.05) for m in middles[i % 20]], i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    store = annuli.Annuli(annuli.labelled_vectors(df), pivots=20, block_rows=32)
    reads = spark.sparkContext.accumulator(0)
    search = annuli._Search

    class Counted(search):
        def _scan(self, q, columns, place, low, high, shard, store):
            class Reader:
                def read(self, file, at):
                    reads.add(1)
                    return store.read(file, at)

            return super()._scan(q, columns, place, low, high, shard, Reader())

    annuli._Search = Counted
    try:
        chosen = F.col("vec_id") % 500 == 0
        anchors = 4
        got = store.mine(chosen, batch_rows=1)
        assert sorted(map(tuple, got.select(*COLS).collect())) == brute(rows, 500)
    finally:
        annuli._Search = search
    assert reads.value < 1.2 * anchors * store.store.index.count()  # two searches an anchor, of which the first ends early
