"""Extra columns that bear the names which the operators use inside change nothing."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import decontaminate, queries
from loomwright.llm.arrow import sized
from loomwright.staging import stage

SF = "/root/testdata/sf0.001"
NAMES = """id key th met_key met_th leaky_key leaky_th words g1 g5 m10 s10 fp fps span spans item items n i s n_words n_hit row text_hash stays repeated kept component
h h1 h2 shard line lines c0 c1 carry gone_id gone_th sizes bits counts keepers cls size source_size target taken slot block rank score file at place pivot cell ask no
page_id_2 digest payload offset length v norm query_id query_no theta code error of label_2 toxic_2 tox_score remainder bucket minimiser start end sha place_2 d l k w x q a b""".split()
TABLES = {"documents": 60, "pages": 40, "embeddings": 120, "benchmark": 20, "labels": 60}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    plain, clashing = (str(tmp_path_factory.mktemp(n)) for n in ("plain", "clashing"))
    for name, rows in TABLES.items():
        table = spark.read.parquet(f"{SF}/{name}.parquet").limit(rows).coalesce(1)
        table.write.parquet(f"{plain}/{name}.parquet")
        table = spark.read.parquet(f"{plain}/{name}.parquet")
        extra = [F.lit(j).alias(c) if j % 2 else F.array(F.lit("a")).alias(c) for j, c in enumerate(NAMES) if c not in table.columns]
        table.select(*extra, "*").write.parquet(f"{clashing}/{name}.parquet")
    return plain, clashing


def rows(df):
    return df.columns, sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, folders, name):
    want, got = (rows(queries.QUERIES[name](spark, d)) for d in folders)
    assert got == want and want[1]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, folders, name):
    stages = dict(corpus_pipeline.STAGES)
    want, got = (rows(stages[name](spark, spark.read.parquet(f"{d}/documents.parquet"), d)) for d in folders)
    assert got == want and want[1]
    assert name == "mixing" or tuple(want[0]) == corpus_pipeline.COLUMNS


def test_rows_keep_their_columns(spark, folders):
    docs = spark.read.parquet(f"{folders[1]}/documents.parquet")
    left = decontaminate.without_leaks(docs, spark.read.parquet(f"{folders[1]}/benchmark.parquet"))
    assert left.columns == docs.columns and 0 < left.count() <= docs.count()
    assert decontaminate.without_leaks(docs.limit(0), spark.read.parquet(f"{folders[1]}/benchmark.parquet")).count() == 0


def test_broadcast_is_bound_by_rows_and_bytes(spark, monkeypatch):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    keys = stage(spark.range(200).select("id", F.sequence(F.lit(0), F.lit(99)).alias("lines")), "keys")
    assert hinted(sized(keys)) and hinted(sized(keys.limit(0)))
    monkeypatch.setattr("loomwright.llm.arrow.BROADCAST_BYTES", 100_000)
    assert not hinted(sized(keys)) and hinted(sized(keys.select("id")))
    monkeypatch.setattr("loomwright.llm.arrow.BROADCAST_ROWS", 100)
    assert not hinted(sized(keys.select("id")))
