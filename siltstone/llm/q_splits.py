"""Queries on divisions of questions and legal documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import splits as S
from siltstone.sources.tables import table


def _batches(spark: SparkSession, d: str):
    queries, docs, qrels = (table(spark, d, t) for t in ("queries_train", "legal_docs", "qrels"))
    first, later = S.legal_batches(queries, docs, qrels)
    return first, later, S.stored_sides(table(spark, d, "doc_disjoint_split")), queries


def _incremental(spark: SparkSession, d: str, keep_assigned: bool) -> tuple[S.State, DataFrame]:
    """The stored division with its questions and acts, stored as a table and extended by the judgements."""
    first, later, sides, queries = _batches(spark, d)
    state, _ = S.extended(None, *first, sides, keep_assigned=keep_assigned)
    return S.extended(state, *later, None, keep_assigned=keep_assigned)[0], queries


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return S.conflicts(*_incremental(spark, d, False))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Components of the stored table after the batch of judgements; the same as of one solve."""
    return S.components(_incremental(spark, d, True)[0])


def p1_moves(spark: SparkSession, d: str) -> DataFrame:
    """Records whose component the batch of judgements put into quarantine, as it merged components of different sides."""
    state, _ = _incremental(spark, d, True)
    return S.split(state).filter("quarantined").select("kind", "record_id")


def _whole(spark: SparkSession, d: str) -> tuple[S.State, DataFrame]:
    first, later, sides, _ = _batches(spark, d)
    return S.extended(None, first[0].union(later[0]).distinct(), first[1].union(later[1]).distinct(), sides)[0], sides


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """A whole division that keeps the stored sides where they do not conflict."""
    return S.split(_whole(spark, d)[0])


def p1_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """What ``p1_splits`` must fulfil, counted over all its records."""
    return S.split_checks(*_whole(spark, d))


_W = r"'^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'"


def _id(c: str) -> str:
    t = f"regexp_replace({c}, {_W})"
    return f"CASE WHEN lower({t}) NOT IN ('', 'nan', 'none', 'null') THEN {t} END"


QUERIES = {"p1_found": p1_found, "p1_incremental": p1_incremental, "p1_moves": p1_moves, "p1_splits": p1_splits, "p1_split_checks": p1_split_checks}
_TIES = f"""WITH RECURSIVE
      j AS (SELECT DISTINCT 'q:' || {_id("query_id")} AS a, 'd:' || {_id("document_id")} AS b FROM qrels WHERE relevance = 1),
      judged AS (SELECT a, b FROM j WHERE a IS NOT NULL AND b IS NOT NULL),
      ties AS (SELECT a, b FROM judged
        UNION SELECT 'q:' || query_id, 'n:' || question_norm FROM queries_train WHERE question_norm IS NOT NULL
        UNION SELECT 'd:' || doc_id, 'a:' || lower(regexp_replace(legal_number, {_W})) FROM legal_docs WHERE regexp_replace(legal_number, {_W}) <> ''),
      both_ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
      sides AS (SELECT DISTINCT 'q:' || {_id("u")} AS n, 'train' AS side FROM (SELECT unnest(train_qids) AS u FROM doc_disjoint_split)
        UNION SELECT DISTINCT 'q:' || {_id("u")}, 'validation' FROM (SELECT unnest(val_qids) AS u FROM doc_disjoint_split)
        UNION SELECT DISTINCT 'd:' || {_id("u")}, 'train' FROM (SELECT unnest(train_doc_ids) AS u FROM doc_disjoint_split)
        UNION SELECT DISTINCT 'd:' || {_id("u")}, 'validation' FROM (SELECT unnest(val_doc_ids) AS u FROM doc_disjoint_split)),
      known AS (SELECT DISTINCT 'q:' || query_id AS n, query_id FROM queries_train WHERE query_id IS NOT NULL)"""
_RECORDS = """
      records AS (SELECT n FROM known UNION SELECT 'd:' || doc_id FROM legal_docs WHERE doc_id IS NOT NULL UNION SELECT a FROM judged UNION SELECT b FROM judged UNION SELECT n FROM sides WHERE n IS NOT NULL),
      reach AS (SELECT n AS root, n FROM records UNION SELECT r.root, e.b FROM reach r JOIN both_ways e ON e.a = r.n)"""
_KIND = "CASE WHEN left({0}, 1) = 'q' THEN 'query' ELSE 'document' END"
SQL = {
    "p1_found": f"""{_TIES},
      reach AS (SELECT n AS root, n FROM known UNION SELECT r.root, e.b FROM reach r JOIN both_ways e ON e.a = r.n),
      bad AS (SELECT root FROM reach JOIN sides USING (n) GROUP BY root HAVING count(DISTINCT side) > 1),
      named AS (SELECT r.root, min(k.query_id) AS group_id FROM reach r JOIN known k ON k.n = r.n WHERE r.root IN (SELECT root FROM bad) GROUP BY r.root)
      SELECT group_id, k.query_id AS query_id FROM named JOIN known k ON k.n = named.root""",
    "p1_incremental": f"""{_TIES},{_RECORDS}
      SELECT {_KIND.format("root")} AS kind, substr(root, 3) AS record_id, min({_KIND.format("reach.n")} || ':' || substr(reach.n, 3)) AS group_name
      FROM reach WHERE n IN (SELECT n FROM records) GROUP BY root""",
    # The counts of a right division.
    "p1_split_checks": f"""{_TIES},{_RECORDS}
      SELECT count(*) AS n_records, CAST(0 AS BIGINT) AS sides_out_of_bounds, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS moved, CAST(0 AS BIGINT) AS quarantined_with_side FROM records""",
}
