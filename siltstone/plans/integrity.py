"""Queries on referential integrity between chunks, judgements and their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import orphans as O
from siltstone.sources.tables import table

_ABSENT = "('', 'nan', 'none', 'null')"


def _refs(spark: SparkSession, d: str) -> list[O.Reference]:
    chunks, qrels = table(spark, d, "chunks"), table(spark, d, "qrels")
    return [
        O.Reference("chunks", "document_id", "chunk_id", "legal_docs", chunks),
        O.Reference("qrels", "document_id", "qrel_id", "legal_docs", qrels),
        O.Reference("qrels", "query_id", "qrel_id", "queries_train", qrels),
    ]


def _targets(spark: SparkSession, d: str) -> list[O.Target]:
    return [O.Target("legal_docs", "doc_id", table(spark, d, "legal_docs")), O.Target("queries_train", "query_id", table(spark, d, "queries_train"))]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return O.broken_references(_refs(spark, d), _targets(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(p3_found(spark, d))


def p3_orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_keys(O.merge_state(O.reference_deltas(_refs(spark, d)), O.existence_deltas(_targets(spark, d))))


def _id(c: str) -> str:
    t = rf"regexp_replace(CAST({c} AS VARCHAR), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
    return f"CASE WHEN lower({t}) NOT IN {_ABSENT} THEN {t} END"


_ROWS = f"""
refs AS (
  SELECT 'chunks' AS table_name, 'document_id' AS column_name, 'legal_docs' AS target, {_id("chunk_id")} AS row_key, {_id("document_id")} AS k, loaded_at FROM chunks
  UNION ALL SELECT 'qrels', 'document_id', 'legal_docs', CAST(qrel_id AS VARCHAR), {_id("document_id")}, loaded_at FROM qrels
  UNION ALL SELECT 'qrels', 'query_id', 'queries_train', CAST(qrel_id AS VARCHAR), {_id("query_id")}, loaded_at FROM qrels),
targets AS (
  SELECT 'legal_docs' AS target, doc_id AS k, min(loaded_at) AS seen, min(deleted_at) AS gone FROM legal_docs GROUP BY doc_id
  UNION ALL SELECT 'queries_train', query_id, min(loaded_at), min(deleted_at) FROM queries_train GROUP BY query_id)
"""
_FOUND = f"""{_ROWS},
found AS (
  SELECT DISTINCT table_name, column_name, row_key, strftime(loaded_at, '%Y-%m') AS load_month,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN seen > loaded_at THEN 'late' WHEN gone <= loaded_at THEN 'deleted' END AS kind
  FROM refs r LEFT JOIN targets t ON t.target = r.target AND t.k = r.k WHERE r.k IS NOT NULL)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_orphan_keys": p3_orphan_keys}
SQL = {
    "p3_found": f"WITH {_FOUND} SELECT * FROM found WHERE kind IS NOT NULL",
    "p3_report": f"WITH {_FOUND} SELECT table_name, column_name, load_month, kind, count(*) AS n_rows FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p3_orphan_keys": f"""WITH {_ROWS} SELECT r.target AS target, r.k AS key, count(*) AS refs, CASE WHEN any_value(t.k) IS NULL THEN 'missing' ELSE 'deleted' END AS kind
      FROM refs r LEFT JOIN targets t ON t.target = r.target AND t.k = r.k
      WHERE r.k IS NOT NULL AND (t.k IS NULL OR t.gone IS NOT NULL) GROUP BY r.target, r.k""",
}
