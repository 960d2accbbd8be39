"""Table functions for SQL, made of expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """kmers(s, k): (place, kmer) of every substring of k characters, places from 0; no rows for shorter or null strings."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION kmers(s STRING, k INT) RETURNS TABLE(place INT, kmer STRING)
        RETURN SELECT i - 1, substring(s, i, k)
        FROM (SELECT explode(CASE WHEN length(s) >= k THEN sequence(1, length(s) - k + 1) ELSE array() END) AS i)
    """)
