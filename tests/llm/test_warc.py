import gzip
import hashlib
import os

import duckdb

from loomwright.llm import warc
from loomwright.staging import fresh_dir

SF = "/root/testdata/sf0.01"


def test_pages_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = sorted(duckdb.sql(f"SELECT {cols} FROM ({warc.OP1_SQL})").fetchall())
    assert sorted(map(tuple, warc.op1(spark, SF).select(*cols.split(", ")).collect())) == want


def test_round_trip_and_odd_rows(spark):
    big = "é\r\n\r\nWARC/1.1" * 20
    rows = [(5, "http://a/%0A\r\nX: y", big), (3, None, big), (4, "u", big), (3, "again", big), (None, "n", big), (9, "s", "short"), (8, "s", "short"), (1, "e", ""), (2, "e", None), (6, "long", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = fresh_dir(spark, "warc")
    index = warc.write_archives(pages, folder, file_bytes=500)
    got = warc.read_records(index, folder).collect()
    assert sorted((str(r.page_id), str(r.url), r.payload_digest) for r in got) == sorted((str(i), str(u), hashlib.sha256((h or "").encode()).hexdigest()) for i, u, h in rows)
    by = {(r.page_id, r.url): r for r in got}
    assert [by[i, u].record_type for i, u, _ in rows] == ["revisit", "response", "revisit", "response", "revisit", "response", "response", "response", "response", "response"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {3} and by[5, rows[0][1]].payload_bytes == len(big.encode())
    assert by[3, None].payload == big.encode() and by[5, rows[0][1]].payload is None
    some = index.where("page_id in (6, 9)")
    assert {r.page_id for r in warc.read_records(some, folder, span=10).collect()} == {6, 9}
    top = folder.removeprefix("file://")
    assert sum(gzip.open(f"{top}/{f}").read().count(b"WARC-Record-ID") for f in os.listdir(top)) == len(rows)
    assert warc.read_records(warc.write_archives(pages.limit(0), folder), folder).count() == 0
