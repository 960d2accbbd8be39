"""Queries of scans, lookups and exports; each goes through files of the source's own format, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables, text
from ..staging import fresh_dir
from .registry import query, table


@query("scan_star", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag FROM lineitem")
def scan_star(spark, d):
    path = fresh_dir(spark, "pairs")
    tables.export(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"), path)
    return text.read_typed(spark, path, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_returnflag string")


@query("scan_text_ordinal", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_name AS line FROM part")
def scan_text_ordinal(spark, d):
    path = fresh_dir(spark, "lines")
    table(spark, d, "part").orderBy("p_partkey").select(F.col("p_name").alias("value")).write.text(path)  # several files, in order
    return text.read_lines(spark, path)


@query("scan_rename", "SELECT p_partkey::VARCHAR AS \"data_id\", replace(p_name, ' ', '_') AS \"data_sequence\" FROM part")
def scan_rename(spark, d):
    path = fresh_dir(spark, "table")
    line = F.concat_ws(" ", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_")))
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return text.read_table(spark, path, ["id", "name"], " ", 2, {"name": "sequence"}, "data_").drop("row_idx")


@query("csv_to_table", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def csv_to_table(spark, d):
    path = fresh_dir(spark, "customers")
    tables.export(table(spark, d, "customer"), path, ",", rows_per_file=500)
    tables.csv_to_table(spark, path, "imported_customers", ",", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return tables.run_sql(spark, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM imported_customers GROUP BY c_mktsegment")


@query("fasta_round_trip", "SELECT p_partkey::VARCHAR AS id, p_brand AS comment, upper(replace(p_name, ' ', '')) AS sequence FROM part")
def fasta_round_trip(spark, d):
    path = fresh_dir(spark, "fasta")
    record = F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_brand"), F.lit("\n"), F.upper(F.replace("p_name", F.lit(" "), F.lit("\n"))))
    table(spark, d, "part").select(record.alias("value")).write.text(path)
    return text.read_fasta(spark, path).select("id", "comment", "sequence")
