"""Queries on the best candidates of every query and branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.topn import row_groups, stored, top_n, top_n_clustered
from siltstone.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "static_candidates"), ["query_id", "branch"], "doc_id", "score", 10).select("query_id", "branch", "place", "doc_id")


def _stored(spark: SparkSession, d: str) -> str:
    return stored(table(spark, d, "static_candidates"), ["query_id", "branch"], "doc_id", "score")


def p5_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same from the stored clustered table, which is written by the first query that needs it."""
    return top_n_clustered(spark, _stored(spark, d), 2, 10).select(F.col("g0").alias("query_id"), F.col("g1").alias("branch"), "place", F.col("item").alias("doc_id"))


def p5_row_groups(spark: SparkSession, d: str) -> DataFrame:
    """Row groups that the query on the stored table reads and skips."""
    return row_groups(spark, _stored(spark, d), 2, 10).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_read").alias("n_read"), F.sum("n_skipped").alias("n_skipped"))


QUERIES = {"p5_found": p5_found, "p5_stored": p5_stored, "p5_row_groups": p5_row_groups}
_FOUND = """
      WITH best AS (SELECT query_id, branch, doc_id, max(score) AS score FROM static_candidates
        WHERE query_id IS NOT NULL AND branch IS NOT NULL AND doc_id IS NOT NULL AND isfinite(score) GROUP BY ALL)
      SELECT query_id, branch, CAST(place AS INTEGER) AS place, doc_id FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, doc_id) AS place FROM best) WHERE place <= 10"""
SQL = {"p5_found": _FOUND, "p5_stored": _FOUND}
