"""Canonical views of the raw tables: one row an id, one name a column.

The last delivery of an id counts; ties are broken by the row's short columns,
never by its texts, so that a query that needs no text neither reads nor
shuffles any.  References are trimmed and what names nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.ids import reference_id
from siltstone.sources.tables import table


def _last(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("loaded_at"), *[F.asc_nulls_last(t) for t in ties])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return _last(table(spark, d, "legal_docs"), "doc_id", ["title", "name_raw", "link", "legal_number", "year", "doc_type"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return _last(table(spark, d, "chunks"), "chunk_id", ["document_id", "article", "clause", "point", "token_count"]).withColumn("doc_id", reference_id(F.col("document_id")))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return _last(table(spark, d, "queries_train"), "query_id", ["gold_count", "question_raw"])


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ``query_id, doc_id`` of relevant judgements."""
    r = table(spark, d, "qrels").filter("relevance = 1")
    return r.select(reference_id(r["query_id"]).alias("query_id"), reference_id(r["document_id"]).alias("doc_id")).dropna().distinct()


def search_set(df: DataFrame, key: str = "query_id", every: int = 50) -> DataFrame:
    """The stated set of search queries: rows whose id's number is divisible by ``every``."""
    n = F.regexp_extract(key, r"(\d+)$", 1).try_cast("bigint")
    return df.filter(n % every == 0)
