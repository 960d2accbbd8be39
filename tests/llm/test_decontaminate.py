import hashlib
import random
import re

import duckdb
import pytest

from loomwright.llm import arrow, decontaminate

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    spans = {}
    for item, text in items:
        ws = cut(text)
        k = min(n, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            spans.setdefault(tuple(ws[i : i + k]), set()).add(str(item))
    out = []
    for d, text in docs:
        ws, hit, names = cut(text), set(), set()
        for k in {len(s) for s in spans}:
            for i in range(len(ws) - k + 1):
                if (found := spans.get(tuple(ws[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((d, len(ws), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_documents_against_sql_and_brute_force(spark):
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = sorted(duckdb.sql(f"SELECT {cols} FROM ({decontaminate.OP3_SQL})").fetchall())
    got = sorted(map(tuple, decontaminate.op3(spark, SF).select(*cols.split(", ")).collect()))
    assert got == want and any(r[5] for r in got)
    plain = brute(*(duckdb.sql(f"SELECT {c}, text FROM {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark"))))
    assert sorted(got) == sorted((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in plain)


@pytest.mark.parametrize(("most_bits", "rows"), [(decontaminate.BitTable.MOST_BITS, arrow.BROADCAST_ROWS), (64, 0)])
def test_random_texts_with_short_items(spark, monkeypatch, most_bits, rows):
    """Also with a bit table far too small for the benchmark, and with keys that are not broadcast."""
    monkeypatch.setattr(decontaminate.BitTable, "MOST_BITS", most_bits)
    monkeypatch.setattr(arrow, "BROADCAST_ROWS", rows)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(50)] + [(50, None), (51, ""), (None, text(30)), (3, text(40)), (3, text(40)), (52, "a, B. " * 3000), (53, "É a É B ſ" * 5), (54, "é a é b s" * 5)]
    items = [(i, text(rng.choice([0, 1, 2, 3, 7, 8, 9, 10, 11, 14]) if i < 4 else rng.choice([7, 8, 9, 10, 11, 14]))) for i in range(12)] + [(20, None)]
    for chosen in (items, items[6:], [(20, None)]):
        df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, words int")
        got = decontaminate.find_leaks(df, spark.createDataFrame(chosen, "item_id long, text string"))
        assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str) == brute(docs, chosen)
    assert decontaminate.find_leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
