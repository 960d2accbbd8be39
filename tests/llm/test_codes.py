import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwright.llm import codes

SF = "/root/testdata/sf0.01"
MOST = 2**52


def brute(rows, parts, entries, rounds):
    """({(id, code, error)}, books): plain Lloyd on Python's integers."""
    kept = [(i, [max(-MOST, min(MOST, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = parts * max(1, -(-max(len(v) for _, v in kept) // parts))
    kept = sorted(((i, v + [0] * (width - len(v))) for i, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    own, out = width // parts, [("", 0)] * len(kept)
    books = []
    for p in range(parts):
        xs = [v[p * own : (p + 1) * own] for _, v in kept]
        book = [list(x) for x in xs[:entries]]

        def assign(xs=xs, book=book):
            found = []
            for x in xs:
                d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
                found.append((min(d), d.index(min(d))))
            return found

        for _ in range(rounds):
            at = assign()
            for e in range(len(book)):
                mine = [x for x, (_, c) in zip(xs, at, strict=True) if c == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        out = [(code + f"{c:02x}", error + d) for (code, error), (d, c) in zip(out, assign(), strict=True)]
        books.append(book)
    return sorted(((i, c, min(e, 2**63 - 1)) for (i, _), (c, e) in zip(kept, out, strict=True)), key=str), books


def check(spark, rows, parts=2, entries=5, rounds=4, block_rows=16):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, part string, code int")
    got = codes.Codes(codes.integer_parts(df, label_col=None), parts, entries, rounds, block_rows)
    want, books = brute(rows, parts, entries, rounds)
    assert sorted(map(tuple, got.codes().select("vec_id", "code", "error").collect()), key=str) == want
    assert got.sha256() == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return got


def test_embeddings_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cols = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(duckdb.sql(f"SELECT {', '.join(cols)} FROM ({codes.OP11_SQL})").fetchall())
    assert sorted(map(tuple, codes.op11(spark, SF).select(*cols).collect())) == want and len(want) == 500


def test_heaps_equal_plain_lloyd_and_skip_parts(spark):
    rng = random.Random(3)
    middles = [[rng.uniform(-9, 9) for _ in range(6)] for _ in range(8)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in middles[i % 8]]) for i in range(300)]
    got = check(spark, rows, parts=2, entries=8, rounds=6)
    assert got.popped[0] == 600 and sum(got.popped[1:]) < 2400  # of 3,600


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12, 1e300])
def test_odd_vectors(spark, scale):
    rng = random.Random(5)
    rows = [(i, [scale * rng.choice([-1, -0.5, 0.25, rng.random()]) for _ in range(5 if i % 7 else 3)]) for i in range(40)]
    rows += [(99, rows[3][1])] * 12 + [(None, rows[4][1]), (3, rows[5][1]), (50, None), (51, [None, 1.0]), (52, [math.nan]), (53, [math.inf, 0.0]), (54, []), (55, [0.0] * 5)]
    check(spark, rows)
    check(spark, rows, parts=3, entries=1, rounds=2)
    check(spark, rows[:3], entries=256)


def test_labels_and_empty_tables(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0, 0.0, float(i)], None if i % 3 == 0 else i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("of", F.lit(1))
    df.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = codes.op11(spark, f"{tmp_path}/a").collect()
    for kind in (None, 0, 1):
        mine = [r for r in got if rows[r.vec_id][2] == kind]
        assert {r.label_error for r in mine} == {sum(r.error for r in mine)}
    df.limit(0).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert codes.op11(spark, f"{tmp_path}/b").collect() == []
    bare = codes.Codes(codes.integer_parts(spark.createDataFrame([(1, [])], "vec_id long, embedding array<double>"), label_col=None))
    assert bare.codes().first().code == "00000000" and bare.sha256() == hashlib.sha256(b"").hexdigest()
