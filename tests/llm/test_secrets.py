import hashlib
import re
import time

import duckdb
import pyarrow as pa
import pytest

from loomwright.llm import secrets

SF = "/root/testdata/sf0.01"


def brute(text):
    found = []
    for k, r in enumerate(secrets.RULES):
        found += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(found)]


def test_documents_against_sql_and_plain_scan(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = "doc_id, n_assign, n_access, n_hex, base_sha256, spans"
    want = sorted(duckdb.sql(f"SELECT {cols} FROM ({secrets.OP2_SQL})").fetchall())
    got = sorted(map(tuple, secrets.op2(spark, SF).select(*cols.split(", ")).collect()))
    assert got == want and sum(r[1] + r[2] + r[3] for r in got) > 0
    texts = dict(duckdb.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in got[:300]:
        spans = brute(texts[r[0]])
        assert r[5] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r[4] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in ("assign", "access", "hex")).encode()).hexdigest()


def test_odd_rows(spark):
    texts = [None, "", "PassWord = 'abcdefgh1'", "é token:short token: longenough_", "AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "f" * 31, "x" + "f" * 32 + "x" + "0" * 40, "ſecret=abcdefghij", "api_key:\"" + "a" * 40, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "password secret token=abcdefgh token=" + "q" * 50000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] * 2, "id long, text string, spans int")
    got = secrets.find_secrets(docs, "id", "text", segment_bytes=10).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute(texts[r.id])
    assert secrets.find_secrets(docs.limit(0), "id").count() == 0


@pytest.mark.parametrize(("pattern", "want"), [("abcd", ("and", "abc", "bcd")), ("ab[cd]", ("or", "abc", "abd")), ("[0-9a-f]+", None), ("(abc|xyz)", ("or", "abc", "xyz")), ("abc?d", ("or", ("and", "abc", "bcd"), "abd")), ("ab|abc", None), ("abc.def", ("and", "abc", "def"))])
def test_queries(pattern, want):
    assert secrets.trigram_query(pattern) == want


def test_every_match_is_a_candidate():
    texts = ["xabcx", "ABD", "nothing", "api_key=abcdefgh", "APIKEY: abcdefgh", "secre"]
    for p in ("ab[cd]", "(?ai:api_?key)", "x(abc|nope)x"):
        q = secrets.trigram_query(p)
        got = secrets.Segment.build([t.encode() for t in texts], step=4).candidates(q)
        assert {i for i, t in enumerate(texts) if re.search(p, t)} <= set(got.tolist()) < set(range(len(texts)))


def test_rules_with_small_classes_have_queries():
    for kind, start in (("github", "gho"), ("slack", "xox"), ("jwt", "eyj"), ("assign", "tok")):
        query = secrets.trigram_query(next(r.pattern for r in secrets.RULES if r.kind == kind))
        assert query is not None and start in secrets.trigrams(query)


def test_segments_against_plain_search():
    texts = [b"", b"ab", b"abc", b"xABCx", "wörter".encode(), b"abcabc" * 100, b"bc", b"c"]
    for step in (3, 5, 1 << 20):
        index = secrets.Segment.build(texts, step)
        assert [index.posting(g).tolist() for g in ("abc", "xab", "cab", "\u00f6r", "zzz")] == [[2, 3, 5], [3], [5], [4], []]


def test_stored_index_serves_rules_added_later(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = secrets.build_index(docs, segment_bytes=1 << 16)
    rules = (secrets.Rule("mail", r"[a-z]+@example\\.(com|org)"), secrets.Rule("license", "MIT [Ll]icense"), secrets.Rule("any", "[0-9]+"))
    got = {(r.kind, r.id) for r in secrets.index_candidates(index, rules).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {(k.kind, d) for k in rules for d, t in texts.items() if re.search(k.pattern, t or "")} <= got
    assert {d for k, d in got if k == "any"} == set(texts) and 0 < len([1 for k, _ in got if k == "license"]) < len(texts)
    assert secrets.build_index(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["eyJ" * 3_400_000, ("eyJ" * 1000 + " .eyJ") * 3000, "token" * 2_000_000, "token=abcdefgh " * 700_000, "ghp_" * 2_500_000, "-----BEGIN " * 900_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["id", "text"])
    assert sum(b.num_rows for b in secrets._scan(secrets.RULES, 1 << 20)([batch])) == 1
    assert time.process_time() - began < 15
