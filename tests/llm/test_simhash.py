from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from loomwright.llm import simhash
from loomwright.staging import stage


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fs = list(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for f in fs:
        groups[find(f)].extend(fps[f])
    return {d: min(g) for g in groups.values() for d in g}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fps = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        fps[brute_fingerprint(r.text)].append(r.doc_id)
    want = brute_components(fps)
    got = simhash.op6(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.component_id for r in got} == want
    by_doc = {d: f for f, ds in fps.items() for d in ds}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in by_doc.items()}


def test_crowded_buckets_and_chains(spark):
    base = 0x0123456789ABCDEF
    fps = {base ^ (1 << a) ^ (1 << b): [i] for i, (a, b) in enumerate((a, b) for a in range(12) for b in range(a))}
    fps |= {(base ^ (0b111 << 3 * i)) & (2**64 - 1): [1000 + i] for i in range(21)}
    fps |= {(i * 0x9E3779B97F4A7C15) % 2**64: [2000 + i] for i in range(300)}
    rows = [(f - (1 << 64) if f >> 63 else f, d[0]) for f, d in fps.items()]
    nodes = stage(spark.createDataFrame(rows, "fp long, doc long").select("fp", F.struct(F.col("doc").alias("least"), "fp").alias("node")), "nodes")
    want = brute_components(fps)
    for limit in (2, 10**6):
        found = simhash.components(simhash.links(nodes, bucket_limit=limit))
        labels = {r.node.least: r.label.least for r in found.collect()}
        assert {d[0]: labels.get(d[0], d[0]) for d in fps.values()} == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b", "x"), (4, "a b", "x"), (5, "A B", "y"), (None, "ganz anderes Wort hier", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = {(r.id, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
