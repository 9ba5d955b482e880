"""Queries on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.encode import encode
from siltstone.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
