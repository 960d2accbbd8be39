from collections import Counter, defaultdict

import duckdb
import numpy as np

from loomwright.llm import mixing


def size(text):
    return len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w])


def targets(sizes, limit=3):
    """By halving: the level at which weight times level, cut at the limit, adds up to all sizes."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    lo, hi, total = 0.0, 1e12, sum(sizes.values())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w[s], limit * sizes[s]) for s in order) < total else (lo, mid)
    return {s: min(lo * w[s], limit * sizes[s]) for s in order}


def test_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    runs = [sorted(map(tuple, mixing.op7(spark, "/root/testdata/sf0.01").collect())) for _ in range(2)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == sorted(docs)
    sizes, taken = Counter(), Counter()
    for d in docs.values():
        sizes[d.source] += size(d.text)
    want = targets(sizes)
    for d, n, source_size, target, got in runs[0]:
        assert n == size(docs[d].text) and source_size == sizes[docs[d].source] and abs(target - want[docs[d].source]) < 1e-3
        assert 0 <= got <= 3 * n
        taken[docs[d].source] += got
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(256, 0.03 * want[s])


def test_pieces_are_the_words_of_the_documents(spark):
    rows = [(i, " ".join(f"{i}.{j}" for j in range(i % 37)), "abc"[i % 3 if i % 7 else 0], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at int")
    mix = mixing.Mix(docs, block_words=8, shard_slots=50)
    got = mix.texts(docs).collect()
    seen = defaultdict(Counter)
    for r in got:
        words = r.text.split()
        assert len(words) <= 8
        seen[r.s].update(words)
    whole = Counter(w for _, t, *_ in rows for w in t.split())
    assert all(seen[s][w] <= 3 for s in seen for w in seen[s]) and set().union(*seen.values()) <= set(whole)
    assert sum(r.n for r in mix.pieces.collect()) == sum(sum(c.values()) for c in seen.values()) == sum(r.taken for r in mix.taken().collect())


def test_permutation_and_shares(spark):
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, (1, 2, 3)).tolist()) == list(range(n))
    for sizes, want in (([10, 100, 1000], [30.0, 300.0, 780.0]), ([0, 0], [0.0, 0.0]), ([], [])):
        table = spark.createDataFrame([(i, n, (5.0, 2.0, 1.0)[i]) for i, n in enumerate(sizes)], "s int, size long, weight double")
        assert [r.target for r in mixing.water_fill(table, 3).orderBy("s").collect()] == want


def test_many_sources_and_shards(spark):
    """Thousands of sources, and of shards of a fixed number of slots; each source is within a block of its target."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 1 + id % 11), x -> 'w')) as text", "concat('s', id % 3000) as source")
    mix = mixing.Mix(docs, block_words=2, shard_slots=4)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    want, taken = targets(sizes), Counter()
    for r in mix.taken().collect():
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    assert len(sizes) == 3000 and all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    slots = {(r.shard, r.slot) for r in mix.pieces.collect()}
    held = Counter(shard for shard, _ in slots)
    assert len(held) > 4096 and set(held[i] for i in range(len(held) - 1)) == {4}
    again = mixing.Mix(docs.repartition(7), block_words=2, shard_slots=4, batch_slots=3)
    cols = ["doc_id" if c == "id" else c for c in ("id", "source", "size", "target", "taken")]
    assert sorted(map(tuple, mix.taken().selectExpr("id doc_id", "source", "size", "target", "taken").select(cols).collect())) == sorted(map(tuple, again.taken().selectExpr("id doc_id", "source", "size", "target", "taken").select(cols).collect()))


def test_counts_of_shards_are_a_draw_given_the_totals(spark):
    """Every shard's slots, and every source's, add up; the counts spread as those of a multinomial draw with these totals do."""
    docs = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 8), x -> 'w')) as text", "concat('s', id % 3) as source")
    mix = mixing.Mix(docs, block_words=4, shard_slots=50)
    counts = mix.counts.collect()
    shards, sources = Counter(), Counter()
    for r in counts:
        shards[r.shard] += r.slots
        sources[r.s] += r.slots
    total = sum(sources.values())
    assert sorted(shards) == list(range(-(-total // 50))) and all(shards[i] == 50 for i in range(total // 50))
    own = Counter((r.shard, r.s) for r in {(r.shard, r.slot): r for r in mix.pieces.collect()}.values())
    assert own == {(r.shard, r.s): r.slots for r in counts}
    share = sources[0] / total
    drawn = np.array([next((r.slots for r in counts if (r.shard, r.s) == (i, 0)), 0) for i in range(total // 50)])
    spread = 50 * share * (1 - share)
    assert abs(drawn.mean() - 50 * share) < 3 * (spread / len(drawn)) ** 0.5 and 0.6 < drawn.var() / spread < 1.5
    again = mixing.Mix(docs.repartition(5), block_words=4, shard_slots=50)
    assert sorted(map(tuple, again.counts.collect())) == sorted(map(tuple, counts))


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_RUN", 7)
    docs = spark.range(100).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "'x' as source")
    mix = mixing.Mix(docs, block_words=4)
    assert sorted(r["at"] for r in mix.documents.collect()) == list(range(0, 300, 3))


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d\te\x0bf", None), (None, "g " * 3000, "y"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.Mix(docs).taken().collect()
    assert sorted(r["size"] for r in got) == [0, 0, 0, 3, 3, 3, 3000]
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.Mix(docs.limit(0)).taken().count() == 0 and mixing.Mix(docs.where("doc_id = 2")).taken().count() == 1


def test_texts_of_repeated_rows(spark):
    rows = [(None, "a b c d", "x")] * 5 + [(1, "a b c d", "x"), (1, "e f g", "x"), (1, "e f g", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(docs, block_words=4)
    words = Counter(w for r in mix.texts(docs).collect() for w in r.text.split())
    assert sum(words.values()) == sum(r.taken for r in mix.taken().collect()) == 30 and words["a"] == 6 and words["g"] == 2


def test_targets_against_sql(spark, tmp_path):
    rows = [(i, "w " * (i % 50), None if i % 9 == 0 else f"s{(i * i) % 40}") for i in range(300)] + [(None, None, "s1"), (5, "x", "only")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in ("/root/testdata/sf0.01", str(tmp_path)):
        where = f"{folder}/documents.parquet" + ("/*.parquet" if folder == str(tmp_path) else "")
        duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{where}'")
        want = duckdb.sql(f"SELECT doc_id, size, source_size, target FROM ({mixing.MIX_TARGETS_SQL})").fetchall()
        assert sorted(map(tuple, mixing.mix_targets(spark, folder).collect()), key=str) == sorted(want, key=str) and want
