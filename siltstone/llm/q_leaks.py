"""Queries on evaluation items inside the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.leaks import leaks, without_leaks
from siltstone.sources.tables import table


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim run of every document and item."""
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").withColumnRenamed("doc_key", "doc_id").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_matches(spark, d).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = leaks(docs, "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return without_leaks(docs.select("doc_id", "source"), "doc_id", found)


_WORDS = (
    "regexp_extract_all(lower(nfc_normalize(regexp_replace(text, "
    r"'[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]+', '', 'g'))), "
    r"'[\p{L}\p{N}]+')"
)
_FOUND = f"""
  WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
  ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12),
  dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
  found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""
QUERIES = {"p8_found": p8_found, "p8_matches": p8_matches, "p8_clean": p8_clean}
_MATCHES = f"""
  WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items),
  ig AS (SELECT item_id, unnest(range(0, len(w) - 11)) AS q, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12),
  dg AS (SELECT doc_id, unnest(range(0, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
  hit AS (SELECT doc_id, item_id, p, q, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM dg JOIN ig USING (g)),
  runs AS (SELECT doc_id, item_id, count(*) + 11 AS n_words, min(p) AS doc_word, min(q) AS item_word FROM hit GROUP BY doc_id, item_id, p - q, run)
  SELECT doc_id, item_id, n_words, doc_word, item_word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) AS k FROM runs) WHERE k = 1"""
SQL = {"p8_matches": _MATCHES, "p8_found": f"{_FOUND} SELECT * FROM found", "p8_clean": f"{_FOUND} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM found)"}
