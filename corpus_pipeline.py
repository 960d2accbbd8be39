"""Corpus cleaning in five stages: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwright.llm import decontaminate, jaccard, lines, mixing, toxicity
from loomwright.llm.arrow import sized
from loomwright.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECT; null and empty texts score as the model's bias, and repeated rows alike. An empty table gives no rows."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, carry=COLUMNS)
    return scored.where(F.col("tox_score") < REJECT).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(COLUMNS)])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that several share; n_chars is that of what is left. A null text becomes empty. An empty table gives no rows."""
    left = lines.dedup_lines(docs, carry=("lang", "source"))
    return left.select(F.col("id").alias("doc_id"), "text", F.col("c0").alias("lang"), F.col("c1").alias("source"), F.length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of similar documents; a null id is the smallest.

    The SimHash operator in its verified form: similar are documents whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more. Null and empty texts are similar to one another. Which of several texts with one id stays
    is settled by their hashes, and of exact repeats the one with the smallest lang, source and n_chars. What goes is the
    smaller part, and is anti-joined: it is broadcast up to a fixed size, and else the texts are shuffled once. An empty table gives no rows.
    """
    found = jaccard.near_duplicates(docs).groupBy("id", "text_hash").agg(F.max("component").alias("component"), F.count("*").alias("n"))
    found = stage(found, "found")  # one text has one component
    kept = stage(found.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("kept")), "kept")
    stays = F.struct("id", "text_hash").eqNullSafe(F.col("kept"))
    gone = stage(found.join(kept, "component").select("id", "text_hash", stays.alias("stays"), (F.col("n") > 1).alias("repeated")).where("not stays or repeated"), "near_copies")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash"))
    docs = docs.select(*COLUMNS)
    single = docs.join(sized(gone), own, "left_anti")
    several = stage(gone.where("stays"), "repeated")
    if several.isEmpty():
        return single
    repeated = docs.join(sized(several), own).groupBy("id", "text_hash").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return single.union(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none and stay, as do rows with a null id. An empty table gives no rows."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document: what the mix takes of it, in words; nothing of null and empty texts. An empty table gives no rows."""
    taken = mixing.Mix(docs).taken()
    return taken.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity model and the draws of the mix are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
