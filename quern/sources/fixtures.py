"""Adapters from stored tables to the library's tables: files, commits, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content, language) of documents."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return d.select("doc_id", path.alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, author, ts, message) of orders; the message stands for the order's priority."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    p = F.col("o_orderpriority")
    message = (
        F.when(p.startswith("1"), F.concat(F.lit("Fix bug in order "), key))
        .when(p.startswith("2"), F.concat(F.lit("feat(core): add order "), key))
        .when(p.startswith("3"), F.concat(F.lit("Merge branch "), key))
        .when(p.startswith("4"), F.concat(F.lit("Update readme "), key, F.lit(" closes #"), key))
        .otherwise(F.concat(F.lit("chore: tidy "), key))
    )
    return o.select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("ts"), message.alias("message"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, file, insertions, deletions) of lineitem."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"), q.cast("long").alias("insertions"), F.floor(q * F.col("l_discount")).cast("long").alias("deletions")
    )


#: The same tables for the oracle.
SQL = """
WITH commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, CAST(o_orderdate AS TIMESTAMP) AS ts,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Fix bug in order ' || o_orderkey WHEN '2' THEN 'feat(core): add order ' || o_orderkey
    WHEN '3' THEN 'Merge branch ' || o_orderkey WHEN '4' THEN 'Update readme ' || o_orderkey || ' closes #' || o_orderkey ELSE 'chore: tidy ' || o_orderkey END AS message FROM orders),
changes AS (SELECT l_orderkey AS commit_id, l_partkey AS file, CAST(l_quantity AS BIGINT) AS insertions, CAST(floor(l_quantity * l_discount) AS BIGINT) AS deletions FROM lineitem),
files AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, text AS content, lang AS language FROM documents)
"""
