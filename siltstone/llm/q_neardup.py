"""Queries on articles and acts that recur with small changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.neardup import groups, links, pairs_of
from siltstone.sources.tables import table

TABLES = (("macro_chunks", "chunk_id", "text"), ("legal_docs", "doc_id", "document_text"))


def _texts(spark: SparkSession, d: str, name: str, key: str, text: str) -> DataFrame:
    return table(spark, d, name).select(F.col(key).alias("id"), F.col(text).alias("text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key, text in TABLES:
        link, members = links(_texts(spark, d, name, key, text), words=3, threshold=0.6, min_words=20, weighted=False)
        one = pairs_of(link, members).select(F.lit(name).alias("table_name"), F.col("a").alias("id_a"), F.col("b").alias("id_b"))
        out = one if out is None else out.union(one)
    return out


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups at the usual five words and a weighted similarity of 0.8."""
    out = None
    for name, key, text in TABLES:
        one = groups(_texts(spark, d, name, key, text), min_words=20).withColumn("table_name", F.lit(name))
        out = one if out is None else out.union(one)
    return out


_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, * FROM (
      WITH t AS (SELECT DISTINCT {key} AS id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}),
      s AS (SELECT DISTINCT id, md5(array_to_string(w, ' ')) AS v, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 20),
      n AS (SELECT id, v, count(*) AS n FROM s GROUP BY ALL),
      both_in AS (SELECT a.id AS ia, a.v AS va, b.id AS ib, b.v AS vb, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
      SELECT DISTINCT ia AS id_a, ib AS id_b FROM both_in x JOIN n a ON a.id = ia AND a.v = va JOIN n b ON b.id = ib AND b.v = vb WHERE k >= 0.6 * (a.n + b.n - k))"""
    for name, key, text in TABLES
)
_GROUPS = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, id, group_id, n_links FROM (
      WITH RECURSIVE t AS (SELECT DISTINCT {key} AS id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}),
      s AS (SELECT id, list_sort(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM t WHERE len(w) >= 20 AND id IS NOT NULL),
      m AS MATERIALIZED (SELECT DISTINCT id, md5(array_to_string(sh, '|')) AS c FROM s),
      e AS MATERIALIZED (SELECT c, g, count(*) AS n FROM (SELECT c, unnest(sh) AS g FROM (SELECT md5(array_to_string(sh, '|')) AS c, any_value(sh) AS sh FROM s GROUP BY c)) GROUP BY ALL),
      z AS (SELECT c, sum(n) AS n FROM e GROUP BY c),
      k AS (SELECT a.c AS a, b.c AS b, sum(least(a.n, b.n)) AS k FROM e a JOIN e b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
      l AS MATERIALIZED (SELECT a, b FROM k JOIN z x ON x.c = a JOIN z y ON y.c = b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.8 - 1e-12),
      bw AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach AS (SELECT DISTINCT c AS root, c FROM m UNION SELECT r.root, bw.b FROM reach r JOIN bw ON bw.a = r.c),
      f AS (SELECT c, min(id) AS first, count(*) AS n FROM m GROUP BY c), grp AS (SELECT root AS c, min(first) AS group_id FROM reach JOIN f USING (c) GROUP BY root),
      nl AS (SELECT a AS c, sum(f.n) AS n_links FROM bw JOIN f ON f.c = bw.b GROUP BY a)
      SELECT id, group_id, coalesce(n_links, 0)::BIGINT AS n_links FROM m JOIN grp USING (c) LEFT JOIN nl USING (c))"""
    for name, key, text in TABLES
)
QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL = {"p4_found": _SQL, "p4_groups": _GROUPS}
