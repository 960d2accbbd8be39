import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import labels, sequences as Q, vectors
from loomwright.operators import clusters, geometry, metrics, ordinals, relational as R, sampling as S, text
from loomwright.streaming import windows
from loomwright.staging import fresh_dir


def column(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def test_keep_and_exclude_with_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    names = lambda mode, values: {r.x for r in R.keep_or_exclude(df, {"x": {"mode": mode, "values": values}}).collect()}
    assert names("keep", ["a"]) == {"a"} and names("exclude", ["a"]) == {"b", None}
    assert names("keep", ["a", None]) == {"a", None} and names("exclude", [None]) == {"a", "b"}
    assert R.select_folds(df.withColumnRenamed("x", "split"), "a").count() == 1


def test_checks_fail(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        R.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        R.get_single(df, k=1)
    with pytest.raises(ValueError):
        R.join_composite(df, df.limit(1), ["k"], same_size=True)
    with pytest.raises(Exception, match="no row for key"):
        R.load_by_key(df, spark.createDataFrame([(2, "z")], "t int, w string"), "k", "t").collect()
    with pytest.raises(ValueError):
        S.class_batches(df, "v", "k", {"zzz": 1})
    with pytest.raises(Exception, match="lengths differ"):
        spark.createDataFrame([("a", "bb")], "a string, b string").select(metrics.recovery(F.col("a"), F.col("b"))).collect()


def test_star_join_names(spark):
    facts = spark.createDataFrame([(1, 5, "f"), (2, None, "g")], "id int, lig int, name string")
    ligands = spark.createDataFrame([(5, "l"), (None, "n")], "lid int, name string")
    out = R.star_join(facts, {"ligands": (ligands, "lig", "lid")}, check_unique=True)
    assert out.columns == ["id", "lig", "name", "name_ligands"] and out.count() == 1


def test_running_sums_and_numbers(spark):
    rows = [(i, (i * 7919) % 1000, i % 3 if i % 10 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int, g int").repartition(5)
    got = {r.id: r.s for r in ordinals.running_sums(df, ["id"], {"s": "v"}).collect()}
    total = 0
    for i, v, _ in rows:
        assert got[i] == total
        total += v
    grouped = ordinals.number_in_groups(df, "g", ["id"]).collect()
    for g in (0, 1, 2, None):
        own = sorted((r.id, r.ordinal, r.ordinal_size) for r in grouped if r.g == g)
        assert [o for _, o, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}
    assert ordinals.number_rows(df.limit(0), ["id"]).count() == 0


def test_batches(spark):
    got = S.concat_batches(spark, [10, 20, 30], [3, 2, 1]).collect()
    assert len({r.minibatch_id for r in got}) == 30 and len(got) == 180
    offset, at = [0, 10, 30], [0, 0, 0]
    n, k = [10, 20, 30], [3, 2, 1]
    want = set()
    for m in range(30):
        slot = 0
        for d in range(3):
            for _ in range(k[d]):
                want.add((m, slot, d, offset[d] + at[d] % n[d]))
                at[d] += 1
                slot += 1
    assert {(r.minibatch_id, r.slot, r.dataset, r.sample_id) for r in got} == want
    df = spark.createDataFrame([(i, 1 if i % 5 else 2) for i in range(1000)], "id int, label int")
    got = S.class_batches(df, "label", "id", {1: 5, 2: 5}, batches=1000).collect()
    assert len(got) == 10000
    per = {}
    for r in got:
        per.setdefault(r.minibatch_id, []).append(r.label)
    assert all(sorted(v) == [1] * 5 + [2] * 5 for v in per.values())
    ids = spark.range(10)
    assert [sorted(r.id for r in S.subset_window(ids, "id", 5, e).collect())[0] for e in range(3)] == [0, 5, 0]
    assert [sorted(r.id for r in S.subset_window(ids, "id", 5, e, "reference").collect())[0] for e in range(3)] == [0, 0, 0]


def test_splits_and_weights(spark):
    df = spark.createDataFrame([(i, i % 37) for i in range(2000)], "id int, c int")
    split = S.cluster_split(df, "c", {"train": 0.8, "test": 0.2})
    assert split.groupBy("c").agg(F.count_distinct("set").alias("n")).where("n > 1").count() == 0
    folds = {r.fold: r["count"] for r in S.fold_of_rows(df, "id", 7).groupBy("fold").count().collect()}
    assert max(folds.values()) - min(folds.values()) <= 1 and len(folds) == 7
    w = S.inverse_cluster_weights(df, "c").groupBy("c").agg(F.first("inverse_balance_proportion").alias("w"), F.sum("inverse_balance_proportion").alias("s")).collect()
    assert abs(sum(r.w for r in w) - 1) < 1e-9 and len({round(r.s, 9) for r in w}) == 1


def test_case_runs_and_augmentations(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ABcd-*9") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    for r in df.select("s", Q.case_runs(F.col("s")).alias("runs"), Q.flip_runs(F.col("s"), F.col("id"), 1.0).alias("flipped"), Q.noise(F.col("s"), F.col("id"), 0.0).alias("same"), Q.noise(F.col("s"), F.col("id"), 1.0).alias("other"), Q.swap_adjacent(Q.characters(F.col("s")), F.col("id"), 0.5).alias("swapped")).collect():
        assert "".join(r.runs) == r.s == r.same and all(len({c <= "Z" for c in run}) == 1 for run in r.runs)
        assert r.flipped == "".join(x[::-1] if x[0] <= "Z" else x for x in r.runs)
        assert len(r.other) == len(r.s) and set(r.other) <= set(Q.RESIDUES) and sorted(r.swapped) == sorted(r.s)
    share = spark.range(4000).select(Q.noise(F.lit("-" * 20), F.col("id"), 0.1).alias("s")).collect()
    assert 0.09 < np.mean([20 - r.s.count("-") for r in share]) / 20 < 0.11


def test_tokens(spark):
    assert column(spark, "<A>bc<", lambda x: Q.split_tokens(x)) == ["<A>", "b", "c"]
    assert column(spark, "<CLS>AC j", lambda x: Q.token_ids(x, Q.RESIDUE_VOCABULARY)) == [2, 5, 7, 4]
    assert column(spark, [1, 2, 3], lambda x: Q.pad(x, 5), "array<int>") == [1, 2, 3, 0, 0] and column(spark, [1, 2, 3], lambda x: Q.pad(x, 2), "array<int>") == [1, 2]
    assert column(spark, [1, 2, 3], lambda x: Q.padded_mask(x, 4), "array<int>") == [True, True, True, False]
    assert column(spark, [1, 2, 3, 4], lambda x: Q.roll(x, 5), "array<int>") == [4, 1, 2, 3] and column(spark, [], lambda x: Q.roll(x, 5), "array<int>") == []
    assert column(spark, [[0.1, 0.9], [0.8, 0.2], [0.0, 1.0]], lambda x: Q.best_tokens(x, ["<eos>", "A"]), "array<array<double>>") == "A"
    with pytest.raises(Exception, match="does not end with"):
        column(spark, "abc", lambda x: Q.ends_with(x, "<EOS>"))
    assert column(spark, "ACD", lambda x: Q.decode_residues(Q.encode_residues(x))) == "ACD"
    with pytest.raises(Exception, match="unknown residue"):
        column(spark, "AB", Q.encode_residues)


@pytest.mark.parametrize(("text_", "want"), [("NA", None), (">5", 5.0), ("5±1", 5.0), ("10-20", 10.0), ("-5", None), (" <= 3.5 ", 3.5), ("x", None), ("", None), (None, None), ("1e3", 1000.0), ("=NA", None)])
def test_parse_measure(spark, text_, want):
    assert column(spark, text_, labels.parse_measure) == want


def test_labels_and_vectors(spark):
    kind = "array<struct<concentration:string,unit:struct<name:string>>>"
    label = lambda v: column(spark, v, lambda x: labels.activity_label(x, F.lit(1000.0)), kind)
    assert tuple(label([("20", ("µM",)), ("NA", ("µM",)), ("3", None)])) == (20.0, 20.0, 1)
    assert tuple(label([("200", ("µg/ml",))]))[2] == 0 and tuple(label([]))[2] == -1
    assert abs(column(spark, ">10", labels.affinity) - 8.0) < 1e-9 and column(spark, "1e8", labels.affinity) is None
    assert column(spark, [0.0, 0.0], lambda x: vectors.cosine(x, x), "array<double>") is None


def test_edits_and_alignment():
    assert metrics.edit_counts("A" * 300, "C" + "A" * 299)["equal"] == 0 and metrics.edit_counts("A" * 300, "C" + "A" * 299, False)["equal"] == 299
    rng = random.Random(3)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        c = metrics.edit_counts(a, b)
        assert c["equal"] + c["replace"] + c["delete"] == len(a) and c["equal"] + c["replace"] + c["insert"] == len(b)
        assert c["equal"] == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    matrix = metrics.parse_matrix("# c\n   A  B\nA  4 -1\nB -1  5\n")
    assert metrics.alignment_score("AB", "AB", matrix) == 9 and metrics.alignment_score("AAB", "AB", matrix, gap=-2) == 7
    with pytest.raises(KeyError):
        metrics.alignment_score("Z", "A", matrix)


def test_curves_against_definition(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(20) / 10, int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = ([s for s, y in rows if y == v] for v in (1, 0))
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.auroc(df, "s", "y").first().auroc - want) < 1e-9
    assert metrics.auroc(df.where("y = 1"), "s", "y").first().auroc is None
    points = metrics.roc_points(df, "s", "y").collect()
    for r in points:
        assert abs(r.tpr - sum(p >= r.threshold for p in pos) / len(pos)) < 1e-9


def test_geometry(spark):
    rng = random.Random(5)
    pts = [(i, i % 2, "AB"[i % 3 % 2], *(rng.random() * 4 - 2 for _ in range(3))) for i in range(150)]
    df = spark.createDataFrame(pts, "id int, complex int, chain string, x double, y double, z double")
    got = {(r.a_id, r.b_id) for r in geometry.grid_join(df, df, 0.7, ["complex"], condition=F.col("a_id") < F.col("b_id")).collect()}
    dist = lambda p, q: sum((u - v) ** 2 for u, v in zip(p[3:], q[3:], strict=True)) ** 0.5
    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and p[1] == q[1] and dist(p, q) <= 0.7}
    a = np.random.default_rng(0).normal(size=(20, 3))
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    turn, shift, rmsd = geometry.rigid_fit(a, a @ q + 3)
    assert rmsd < 1e-9 and np.allclose(turn, q) and np.allclose(shift, 3)
    moved = df.withColumns({"x": -F.col("y") + 1, "y": F.col("x"), "z": F.col("z") - 2})
    fits = geometry.superpose(df, moved, "complex", "id")
    back = {r.id: (r.x, r.y, r.z) for r in geometry.apply_rigid(df, fits, "complex").collect()}
    assert all(np.allclose(back[p[0]], (-p[4] + 1, p[3], p[5] - 2)) for p in pts)
    assert geometry.spatial_crop(df, "complex", "chain", "id", 10, 1.0).count() == 20


def test_twins_hide_weak_pairs(spark):
    rows = [(1, c, i, float(i), 0.0, o) for c, o in (("A", 0.0), ("B", 500.0)) for i in range(12)]
    df = spark.createDataFrame(rows, "complex int, chain string, i int, x double, y double, z double").withColumn("l", F.lit("A"))
    chains = geometry.chain_sequences(df, "complex", "chain", "i", "l")
    assert geometry.interaction_classes(df, chains, "complex", "chain").count() == 0
    other = chains.withColumn("sequence", F.concat("sequence", "chain"))
    assert geometry.interaction_classes(df, other, "complex", "chain").first()["class"] == "non_interacting"


def test_clusters(spark):
    base = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL"
    rows = [(1, base), (2, base[:25]), (3, base[:10] + "A" + base[11:]), (4, "W" * 30), (5, base), (6, None), (7, "VV")]
    df = spark.createDataFrame(rows, "id int, s string")
    got = {r.id: r.center for r in clusters.kmer_clusters(df, "id", "s", 5, least_identity=0.9).collect()}
    assert got[1] == got[2] == got[3] == got[5] == 1 and got[4] == 4 and got[7] == 7 and 6 not in got
    assert {(r.center, r.id) for r in clusters.exact_clusters(df, "id", "s").collect()} == {(1, 1), (1, 5), (2, 2), (3, 3), (4, 4), (7, 7)}


def test_merges(spark):
    df = spark.createDataFrame([("low lower lowest",), ("low low new",)], "t string")
    assert [m[:2] for m in text.learn_merges(df, "t", 2)] == [("l", "o"), ("lo", "w")]
    assert text.merge(list("aaa"), "a", "a") == ["aa", "a"]


def test_stream_of_files(spark):
    source, out, progress = (fresh_dir(spark, t) for t in ("in", "out", "progress"))
    spark.range(6).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int) * 20) AS ts", "id % 2 AS k").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        windows.ingest(windows.read_stream(spark, source, schema), out, progress)
        assert spark.read.parquet(out).count() == 6
    stream = windows.drop_repeats(windows.event_time(windows.read_stream(spark, source, schema), delay="1 hour"), ["k"])
    done = stream.writeStream.format("memory").queryName("repeats").trigger(availableNow=True).start()
    done.awaitTermination()
    assert spark.table("repeats").count() == 2
