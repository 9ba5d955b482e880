"""Event-time windows over a stream of files.  An addition to the retrieval operators.

Streams run until what is there has been read and write to the shared folder,
with their checkpoint beside it, so a lost executor or driver continues from
the last finished batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.storage import new_path

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def finished(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input and return what it wrote."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregating stream over all available input; its last state of every key, open windows at the end of input included.

    Every batch writes what it changed under its own number, so a repeated batch
    replaces itself.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).outputMode("update").start().awaitTermination()
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(path)
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; windows close once the watermark passes."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def scored_stream(queries: DataFrame, postings: DataFrame, tokens) -> DataFrame:
    """Stream-static scoring: a stream of ``query_id, question`` joined with stored term weights ``term, doc_id, w``."""
    terms = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term"))
    return terms.join(postings, "term").select("query_id", "doc_id", "term", "w")
