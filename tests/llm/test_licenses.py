import random
import re
import time

import duckdb
import pyarrow as pa
import pytest

from loomwright.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def distance_in(pattern, text):
    """Least edits between pattern and any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_documents_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = licenses.op9(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 0
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert (r.score == 1) >= (r.n_base > 0)


def test_edits_against_dynamic_programming():
    rng = random.Random(2)
    notices = [licenses.Notice(a, b.encode(), k) for a, b, k in licenses.NOTICES]
    for _ in range(300):
        notice = rng.choice(notices)
        text = list("some words before " + notice.text.decode() + " and after")
        for _ in range(rng.randrange(2 * notice.edits + 2)):
            i = rng.randrange(10, len(text) - 5)
            text[i : i + 1] = rng.choice([[], [rng.choice("abc x")], [text[i], rng.choice("abc ")]])
        norm, _ = licenses.normal("".join(text).encode())
        found = licenses.fuzzy_places(norm, notice, notice.seeds(), notice.pattern())
        assert bool(found) == (distance_in(notice.text, norm) <= notice.edits), (norm, notice)
        assert all(e <= notice.edits for *_, e in found)


def test_odd_rows(spark):
    texts = [None, "", "Under the MIT-License; under the mit license", "cc by-nc cc by nc", "GNU Generl Publik License", "ünder the mit license", "x " * 40000 + "Apache License, Version 2.0"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] * 2, "doc_id long, text string, spans int")
    got = licenses.find_licenses(docs)
    assert got.count() == 2 * len(texts)
    for r in got.collect():
        base = [s for s in r.spans if s.base]
        assert (r.n_words, len(base)) == brute(texts[r.id])[:2]
    assert {s.label for r in got.where("id = 4").collect() for s in r.spans} == {"gpl"}
    assert licenses.find_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["under the mit license " * 150_000, "under the " * 330_000, "gnu general public licence " * 130_000, "permission is hereby granted " * 110_000, "license " * 400_000])
def test_long_texts_take_linear_time(text):
    notices = [licenses.Notice(a, b.encode(), k) for a, b, k in licenses.NOTICES]
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["id", "text"])
    began = time.process_time()
    out = list(licenses._scan(licenses.PHRASES, notices)([batch]))
    assert time.process_time() - began < 25
    spans = out[0].column("spans").to_pylist()[0]
    if text.startswith("under the mit"):
        assert [s["first"] for s in spans if s["base"]] == list(range(0, 4 * 150_000, 4))


def test_phrases_against_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    want = sorted(duckdb.sql(f"SELECT {', '.join(cols)} FROM ({licenses.LICENSE_PHRASES_SQL})").fetchall())
    assert sorted(map(tuple, licenses.license_phrases(spark, "/root/testdata/sf0.01").select(cols).collect())) == want and sum(r[2] for r in want) > 0
