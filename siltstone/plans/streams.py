"""Queries on streams, beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.plans import sqlparts as P
from siltstone.sources import canonical as C
from siltstone.sources.tables import table
from siltstone.storage import new_path
from siltstone.streaming import events as V


def x01_tumbling(s, d):
    """Daily windows of a stream; those still open are closed at the end of input."""
    got = V.latest(V.windows(V.stream(s, d).filter("ts is not null"), "1 day"), ["start", "event_type"], "tumbling")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def x02_batch_windows(s, d):
    """The same operator on a table, where every window is complete."""
    got = V.windows(table(s, d, "events"), "1 day")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def x03_sessions(s, d):
    return V.sessions(table(s, d, "events").filter("user_id is not null")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def x04_scored_stream(s, d):
    """Questions that arrive as a stream, looked up in a stored index of title words."""
    docs = C.docs(s, d).select("doc_id", F.explode(F.array_distinct(X.word_tokens(F.col("title")))).alias("term")).withColumn("w", F.lit(1.0))
    path = new_path(s, "asked")
    C.search_set(C.questions(s, d)).select("query_id", F.col("question_raw").alias("question")).write.parquet(path)
    got = V.finished(V.scored_stream(s.readStream.schema("query_id string, question string").parquet(path), docs, X.word_tokens), "scored")
    return got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"))


QUERIES = {"x01_tumbling": x01_tumbling, "x02_batch_windows": x02_batch_windows, "x03_sessions": x03_sessions, "x04_scored_stream": x04_scored_stream}
SQL = {
    "x02_batch_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "x03_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g), c AS (SELECT user_id, i, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "x04_scored_stream": f"""{P.with_tables('docs', 'qs')}, t AS (SELECT DISTINCT doc_id, unnest({P.word_tokens('title')}) AS term FROM docs), q AS (SELECT query_id, unnest({P.word_tokens('question_raw')}) AS term FROM qs WHERE {P.id_number('query_id')} % 50 = 0)
      SELECT query_id, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM q JOIN t USING (term) GROUP BY query_id""",
}
SQL["x01_tumbling"] = SQL["x02_batch_windows"]
