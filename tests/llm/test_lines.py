import duckdb
import numpy as np
import pytest

from loomwright.llm import lines

SF = "/root/testdata/sf0.01"


def test_documents_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(duckdb.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.OP8_SQL})").fetchall())
    got = sorted(map(tuple, lines.op8(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()))
    assert got == want and sum(r[2] for r in want) > 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**63, 50_000, dtype=np.int64).astype(np.uint64) for _ in range(2))
    h1[:10] = h1[0]
    ph = lines.PerfectHash.build(h1, h2)
    assert sorted(ph.find(h1, h2).tolist()) == list(range(50_000))


def test_odd_rows(spark):
    a, b = "this line is long enough to count", "ÄÖÜ" * 7
    rows = [(1, f"{a}\nx"), (2, f" {a.upper()}\t\n{a}"), (3, f"{a}\n{a}"), (None, a), (4, None), (5, ""), (6, b), (7, b), (7, b), (8, b.lower()), (9, "short\nshort"), (10, "short"), (11, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id or 0, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs).collect())
    assert got == [(0, 1, 1, ""), (1, 2, 1, "x"), (2, 2, 2, ""), (3, 2, 0, f"{a}\n{a}"), (4, 1, 0, ""), (5, 1, 0, ""), (6, 1, 0, b), (7, 1, 0, b), (7, 1, 0, b), (8, 1, 0, b.lower()), (9, 2, 0, "short\nshort"), (10, 1, 0, "short"), (11, 1, 0, "short")]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("hot", "shard"), [(0, 10**9), (0, 3), (5, 7), (10**6, 1)])
def test_any_number_of_shards_agrees(spark, hot, shard):
    """Lines that every task holds, and lines that are looked up in shards, one or many."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs).collect()}
    assert {r.id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs, hot_keys=hot, shard_keys=shard).collect()} == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_odd_rows_in_shards(spark):
    rows = [(None, "a line of more than twenty characters\nx", 0, 1)] * 2 + [(i, "a line of more than twenty characters\ny", 0, 1) for i in (1, 2, 2, 3)] + [(4, None, 0, 1), (5, "", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, lines int")
    got = sorted((r.id or 0, r.n_dropped, r.text) for r in lines.dedup_lines(docs, hot_keys=0, carry=("shard",)).collect())
    assert got == [(0, 1, "x"), (0, 1, "x"), (1, 1, "y"), (2, 1, "y"), (2, 1, "y"), (3, 0, "a line of more than twenty characters\ny"), (4, 0, ""), (5, 0, "")]


def test_hot_lines_do_not_leave(spark):
    """A line of all documents is answered by the shard that every task holds; the others are asked for."""
    docs = spark.createDataFrame([(i, f"a line that every document has\nthe line of the group {i % 40:020d}\nan own line of its own, {i:020d}") for i in range(400)], "doc_id long, text string")
    hot, shards, index = lines.line_index(docs, hot_keys=1, shard_keys=10)
    assert shards == 4
    held = spark.sparkContext.broadcast(hot)
    places = docs.selectExpr("doc_id AS id", "text", "xxhash64(text) AS th").mapInArrow(lines._places(held, 20), "h1 long, h2 long, id long, th long, line long")
    assert {r.line for r in places.select("line").distinct().collect()} == {1, 2} and places.count() == 800
    got = lines.dedup_lines(docs, hot_keys=1, shard_keys=10)
    assert sum(r.n_dropped for r in got.collect()) == 399 + 360
