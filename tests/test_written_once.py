"""Queries whose plans once repeated the cleaning of their tables keep to plans of bounded size."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from siltstone.operators import exact as X
from siltstone.operators import memory as M

SF = "/root/testdata/sf0.001"


def windows(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window ")


@pytest.mark.parametrize("name, most", [("j06_numbers", 0), ("r11_exact", 2)])
def test_exact_plans(spark, name, most):
    """What is left of the tables' cleaning in the last step: the chunks' and the ranking."""
    assert windows(E.queries()[name](spark, SF)) <= most + (name == "j04_titles_inside")


def test_contained_shuffles_no_substrings(spark):
    """A long text reaches the join with the keys of titles alone, in any number of blocks."""
    texts = [("a", False, "x" * 500 + " luật đất đai năm nay"), ("b", True, "thue nha o xa hoi"), ("c", False, "ngắn"), ("d", False, None), ("e", False, "thue nha o xa hoi")]
    q = spark.createDataFrame(texts, "query_id string, bare boolean, text string")
    t = spark.createDataFrame([("luật đất đai", False), ("luật đất đai năm nay", False), ("thue nha", True), ("nha o xa hoi", True), ("x" * 12, False), ("ngắn", False), (None, True), ("o xa hoi", True)], "title string, bare boolean")
    want = sorted((i, x["title"], b) for i, b, s in texts for x in t.collect() if s and x["title"] and len(x["title"]) >= X.LEAST and x["bare"] == b and x["title"] in s)
    for block in (X.BLOCK, 2):
        got = X.contained(q, t, block)
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 6
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [8192, 7])
def test_similar_questions_write_no_candidates(spark, block):
    """Pairs are found and verified in one pass a block; nothing is joined or shuffled after it."""
    texts = [(f"{i:02d}", f"thuế đất {i % 7} nộp {i % 5} chậm {i % 3}", i % 2) for i in range(40)]
    q = spark.createDataFrame(texts, "query_id string, text string, part int")
    got = M.similar(q, q, 0.6, block=block)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rows = {(r["part"], r["query_id"], r["train_id"]): r["lexical"] for r in got.collect()}
    tf, df = M.fitted(q)
    w = M.weighted(tf, df)
    a, b = w.select("part", "g", "query_id", F.col("w").alias("x")), w.select("part", "g", F.col("query_id").alias("train_id"), F.col("w").alias("y"))
    every = a.join(b, ["part", "g"]).filter("query_id != train_id").groupBy("part", "query_id", "train_id").agg(F.sum(F.col("x") * F.col("y")).alias("s")).filter("s >= 0.6 - 1e-9")
    assert rows == pytest.approx({tuple(r)[:3]: r["s"] for r in every.collect()}) and len(rows) > 20


@pytest.mark.parametrize("block", [8192, 7])
def test_training_questions_are_written_once(spark, block, monkeypatch):
    """The memory of other folds equals that of questions repeated for every part, of which no repeated one is written."""
    rows = [(f"{i:02d}", f"thuế đất {i % 7} nộp {i % 5} chậm {i % 3}" if i % 11 else None, i % 4) for i in range(40)] + [("a", "khác hẳn", None), ("b", "thuế đất đất đất 1 nộp 2", 9)]
    q = spark.createDataFrame(rows, "query_id string, text string, fold long")
    train = q.filter("query_id != '07'")
    parts = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda p: p != F.col("fold")))
    want = {tuple(r)[:3]: r["lexical"] for r in M.similar(q.withColumnRenamed("fold", "part"), train.withColumn("part", parts).drop("fold"), 0.6).collect()}
    written, settled = [], M.settled
    monkeypatch.setattr(M, "settled", lambda df, name: written.append(settled(df, name)) or written[-1])
    got = M.across_folds(q, train, 5, 0.6, block)
    assert sum(t.count() for t in written) <= train.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {tuple(r)[:3]: r["lexical"] for r in got.collect()} == pytest.approx(want) and len(want) > 20


def test_blocks_of_held_questions_have_one_fold(spark, monkeypatch):
    """So a training question is weighed for one part a block, whatever the number of folds."""
    q = spark.createDataFrame([(f"{i:02d}", f"thuế đất {i % 7} nộp {i % 5}", i % 4) for i in range(40)], "query_id string, text string, fold long")
    paths, blocked = [], M._blocked
    monkeypatch.setattr(M, "_blocked", lambda *a: paths.append(blocked(*a)) or paths[-1])
    M.across_folds(q, q, 4, 0.6, block=3)
    got = spark.read.parquet(paths[0])
    assert got.count() == 40 and got.select("block").distinct().count() > 4
    assert got.groupBy("block").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0


def test_predicted_memory_is_written_once(spark, rows, monkeypatch):
    """Without parts, the memory branch counts n-grams a question and not a row each; the votes are those of ``similar``."""
    from siltstone.plans import pipeline as P

    q = spark.createDataFrame([(f"{i:02d}", f"thuế đất {i % 7} nộp {i % 5} chậm {i % 3}") for i in range(40)] + [("none", None)], "query_id string, question string")
    rel = q.select("query_id", F.concat(F.lit("d"), F.col("query_id")).alias("doc_id")).filter("query_id != '07'")
    cols = ["query_id", "branch", "doc_id", "rank", F.round("score", 8)]
    want = rows(P.memory_branch(q.withColumn("part", F.lit(0)), q.withColumn("part", F.lit(0)), rel, P.Settings()).select(*cols))
    monkeypatch.setattr(P.memory, "similar", None)
    assert rows(P.memory_branch(q, q, rel, P.Settings()).select(*cols)) == want and len(want) > 20
