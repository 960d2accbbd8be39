import random
import zlib

import numpy as np

from loomwright.llm import toxicity


def corpus(n, words=("idiot", "worthless"), seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ws = ["".join(rng.choice("aeioustnr") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 120))]
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(words))
        out.append((i, " ".join(ws), int(i % 4 == 0)))
    return out


def test_learns_and_knows_misspellings():
    rows = corpus(1200)
    model = toxicity.train([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    for words in (("idiot", "worthless"), ("idiots", "worthles", "idiott")):
        held = corpus(400, words, seed=9)
        scores = model.scores([t.encode() for _, t, _ in held])
        y = np.array([v for *_, v in held])
        assert (scores[y == 1] >= 0.7).mean() > 0.9 and (scores[y == 0] >= 0.7).mean() < 0.02


def test_query_shape_and_odd_rows(spark, tmp_path):
    rows = [(i, t, "x", 0) for i, t, _ in corpus(400)] + [(1000, None, "x", 0), (1001, "", "x", 0), (1002, "word " * 30000, "x", 0), (1002, "word", "x", 0), (None, "idiot idiot", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, tox_id int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in corpus(400)] + [(1001, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op5(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    y = {i: v for i, _, v in corpus(400)}
    assert np.mean([r.predicted == y[r.doc_id] for r in got if r.held_out and r.doc_id in y]) > 0.9
    (spark.read.parquet(f"{tmp_path}/labels.parquet").limit(0)).write.parquet(f"{tmp_path}/none/labels.parquet")
    docs.limit(3).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert toxicity.op5(spark, f"{tmp_path}/none").count() == 3
    assert toxicity.score(docs.limit(0), toxicity.train([], [])).count() == 0


def test_rows_of_a_word():
    rows, owner = toxicity.subwords([b"idiot", b"...", b"a"])
    assert set(owner.tolist()) == {0, 1, 2} and rows.max() < toxicity.BUCKETS
    assert (owner == 0).sum() == 1 + 5 + 4 + 3 + 1  # itself, grams of 3, 4 and 5 bytes of <idiot>, and its first 6 bytes


def plain_score(model, text):
    """One word and one segment after another, in Python numbers."""
    words = text.lower().split()
    words = [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
    segments = []
    for lo in range(0, len(words), toxicity.SEGMENT):
        total, n = 0.0, 0
        for w in words[lo : lo + toxicity.SEGMENT]:
            bare = b"<" + (w.strip(toxicity._EDGES) or w) + b">"
            hashes = [zlib.crc32(bare)]
            for size in toxicity.GRAMS:
                for at in range(len(bare) - size + 1):
                    h = bare[at]
                    for b in bare[at + 1 : at + size]:
                        h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
                    hashes.append(h ^ size)
            hashes += [zlib.crc32(bare[:n], n) for n in toxicity.STARTS if len(bare) > n]
            for h in hashes:
                total += float(model.weight[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - toxicity.BUCKET_BITS])
            n += len(hashes)
        segments.append((total / n, total, n))
    top = sorted(segments, key=lambda s: -s[0])[: toxicity.TOP]
    mean = sum(t for _, t, _ in top) / sum(n for *_, n in top) if top else 0.0
    z = model.scale * (model.bias + mean) + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_against_a_plain_version(spark):
    rows = corpus(300)
    model = toxicity.train([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    texts = [t for _, t, _ in corpus(60, seed=5)] + ["", "...", "a", "Idiot! IDIOT idiot", "ä ö worthleß", "x " * 50, "w" * 5000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, model).collect():
        assert abs(r.tox_score - plain_score(model, (texts[r.tox_id] or "").encode())) < 1e-6


def test_few_toxic_rows():
    rows = corpus(120)  # 30 toxic rows
    model = toxicity.train([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    held = corpus(400, seed=9)
    scores, y = model.scores([t.encode() for _, t, _ in held]), np.array([v for *_, v in held])
    assert (scores[y == 1] >= 0.7).mean() > 0.9 and (scores[y == 0] >= 0.7).mean() < 0.05


def test_repeated_ids_in_the_sample(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(60)] * 3 + [(1, "idiot")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(60)] * 2 + [(3, 1), (5, 7)], "doc_id long, toxic int")
    once = toxicity.fit(docs.distinct(), labels.distinct())
    many = toxicity.fit(docs, labels)
    assert np.array_equal(once.weight, many.weight) and (once.scale, once.shift) == (many.scale, many.shift)
