import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from loomwright.llm import arrow, jaccard
from loomwright.staging import stage


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])


def brute_components(texts):
    """texts: id to text. The smallest id of each one's component, all pairs compared."""
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: shingles(t) for d, t in texts.items()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for d in ids:
        groups[find(d)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def components_of(found):
    groups = defaultdict(list)
    for r in found.collect():
        groups[r.component].append(r.id)
    return {d: min(g) for g in groups.values() for d in g}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_components({r.doc_id: r.text for r in docs.collect()})
    assert components_of(jaccard.near_duplicates(docs)) == want
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize(("cell", "rows"), [(jaccard.CELL, arrow.BROADCAST_ROWS), (2, 0)])
def test_groups_and_chains_against_brute_force(spark, monkeypatch, cell, rows):
    """Edits that leave a similarity around the threshold, in groups, chains and stars of many sizes; cells and broadcasts of any size agree."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(arrow, "BROADCAST_ROWS", rows)
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(10**6)}"
    texts = {}
    for group in range(60):
        base = [word() for _ in range(draw.choice([4, 5, 9, 30, 80, 300]))]
        for _ in range(draw.choice([2, 3, 5, 12])):
            words = list(base)
            for _ in range(draw.randrange(1 + len(words) // 25)):
                words[draw.randrange(len(words))] = word()
            texts[len(texts)] = " ".join(words)
            if group % 3 == 0:
                base = words
    docs = stage(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "docs")
    want = brute_components(texts)
    assert len(texts) // 5 < len(set(want.values())) < len(texts) - 50
    assert components_of(jaccard.near_duplicates(docs)) == want


def test_one_row_of_a_component_stays(spark):
    a, b, c = "eins zwei drei vier fünf sechs", "x y z", "etwas ganz anderes als die anderen Texte"
    rows = [(3, a, "de", "q", 1), (3, a, "de", "q", 1), (3, a, "de", "p", 1), (4, a, "de", "p", 1), (None, b, None, None, None), (None, b, None, "s", 2), (7, b, None, "s", 2), (9, c, "de", "s", 3), (9, "anders " + a, "de", "s", 4), (2, "", "de", "s", 0), (2, None, "de", "s", None)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    got = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=repr)
    assert [r for r in got if r[1]] == sorted([(3, a, "de", "p", 1), (None, b, None, None, None), (9, c, "de", "s", 3), (9, "anders " + a, "de", "s", 4)], key=repr)
    assert len([r for r in got if r[0] == 2]) == 1


def test_bitmaps_lose_no_pair():
    draw = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 15, 16, 17, 60, 64, 70, 400):
        base = np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        for share in (0, 0.02, 0.05, 0.1, 0.12, 0.2, 0.5):
            new = draw.integers(0, 2**63, len(base)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            sets.append(np.unique(np.where(draw.random(len(base)) < share, new, base)[: max(1, round(len(base) * draw.uniform(0.85, 1)))]))
    cls, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    probe = cls % 2 == 0
    a, b = jaccard.near_pairs(probe, cls, cls, n, np.zeros(len(sets), bool), [jaccard.bitmap(s) for s in sets])
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    similar = {(i, j) for i in cls[probe].tolist() for j in cls[~probe].tolist() if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert similar <= found and len(found) < 2 * len(similar)
