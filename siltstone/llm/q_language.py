"""Queries on the languages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.language import MIN_WORDS, code_of, held, tag, trained
from siltstone.sources.tables import table


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    net = trained(table(spark, d, "lang_samples"), docs, "doc_id", "text", "lang")
    rows = docs.select(F.struct("doc_id", code_of(F.col("lang")).alias("label")).alias("k"), "text")
    return tag(rows, "k", "text", net)


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language with its confidence."""
    return _tagged(spark, d).select(F.col("doc_key.doc_id").alias("doc_id"), F.inline("segments"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document by its words, its confidence and all languages held; null where there is none."""
    t = _tagged(spark, d)
    by = F.transform(F.array_distinct(F.transform("segments", lambda s: s["lang_code"])), lambda c: F.struct(
        F.aggregate(F.filter("segments", lambda s: s["lang_code"] == c), F.lit(0), lambda n, s: n + s["n_words"]).alias("n"), c.alias("c")))
    main = F.array_max(by)["c"]
    own = F.filter("segments", lambda s: s["lang_code"] == main)
    words = F.aggregate(own, F.lit(0.0), lambda n, s: n + s["n_words"])
    sure = F.try_divide(F.aggregate(own, F.lit(0.0), lambda n, s: n + s["n_words"] * s["confidence"]), words)
    return t.select(F.col("doc_key.doc_id").alias("doc_id"), main.alias("lang_code"), sure.alias("confidence"), F.sort_array(held(t)).alias("held"), "n_words")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    t = _tagged(spark, d)
    t = t.select("doc_key.doc_id", "doc_key.label", "n_words", held(t).alias("held")).filter((F.col("n_words") >= MIN_WORDS) & (F.size("held") > 0))
    wrong = (F.size("held") > 1) | F.col("label").isNull() | (F.col("label") != F.col("held")[0])
    return t.filter(wrong).select("doc_id", F.explode("held").alias("lang_code")).distinct()


QUERIES = {"p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents}
SQL: dict[str, str] = {}
