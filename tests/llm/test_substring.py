import hashlib
import random

import numpy as np

from loomwright.llm import substring


def brute(rows, k=20):
    """rows: (doc_id, text); ids unique and not null."""
    seen, cover = set(), {}
    words = {d: [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w] for d, t in rows}
    for d in sorted(words):
        ws = words[d]
        cover[d] = [False] * len(ws)
        for i in range(len(ws) - k + 1):
            w = tuple(ws[i : i + k])
            if w in seen:
                cover[d][i : i + k] = [True] * k
            seen.add(w)
    return {d: (len(ws), sum(cover[d]), hashlib.sha256(" ".join(w for w, c in zip(ws, cover[d]) if not c).encode()).hexdigest()) for d, ws in words.items()}


def test_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op4(spark, "/root/testdata/sf0.01").collect()}
    want = brute(rows)
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_small_windows_random(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab é") for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, "a " * 500), (61, None), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, m in ((5, 2), (4, 4), (3, 1)):
        got = {r.id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substring.dedup_substrings(docs.repartition(3), k=k, m=m).collect()}
        assert got == brute(rows, k)


def test_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t, 0), (1, t, 1), (2, t, 0), (None, "x " + t, 0)], "doc_id long, text string, ranges int")
    got = sorted(((r.id is None, r.id), r.n_removed) for r in substring.dedup_substrings(docs).collect())
    assert got == [((False, 1), 30), ((False, 1), 30), ((False, 2), 30), ((True, None), 0)]
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_pieces():
    h = np.arange(1, 50, dtype=np.uint64)
    for n in (1, 2, 3, 5, 20, 49):
        g = substring.gram_hashes(h, n)
        assert len(g) == 50 - n and len(set(g.tolist())) == 50 - n
        assert g[-1] == substring.gram_hashes(h[-n:], n)[0]
        assert substring.sliding_min(h[::-1].copy(), n).tolist() == h[::-1][n - 1 :].tolist()


def test_documents_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "doc_id, n_words, n_removed, kept_sha256"
    want = sorted(duckdb.sql(f"SELECT {cols} FROM ({substring.OP4_SQL})").fetchall())
    assert sorted(map(tuple, substring.op4(spark, sf).select(*cols.split(", ")).collect())) == want and sum(r[2] for r in want) > 0


def test_hot_minimisers_are_cut_again(spark, monkeypatch):
    """One gram in very many different windows: with its windows cut again, the results are the same, in many buckets."""
    monkeypatch.setattr(substring, "_SAMPLE", 1)
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(50)}"
    hot = "a b c d"
    rows = [(i, " ".join([*(word() for _ in range(6)), hot, *(word() for _ in range(9))] * 2)) for i in range(300)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(docs.doc_id.alias("id"), docs.doc_id.alias("th"), "text")
    found = substring.hot_minimisers(keyed, 12, 4, 2000, 1 << 20)
    assert 0 < len(found) < 200 and (np.sort(found) == found).all()
    words = [w for _, t in rows for w in t.split()]
    doc = np.repeat(np.arange(len(rows)), [len(t.split()) for _, t in rows])
    plain, cut = (substring.super_kmers([w.encode() for w in words], doc, 12, 4, h) for h in (None, found))
    covered = lambda x: sorted(w for a, z in zip(x[0].tolist(), x[1].tolist(), strict=True) for w in range(a, z + 1))
    assert covered(plain) == covered(cut)
    assert np.unique(cut[2], return_counts=True)[1].max() < np.unique(plain[2], return_counts=True)[1].max() / 2
    got = {r.id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substring.dedup_substrings(docs, k=12).collect()}
    assert got == brute(rows, 12)
