"""A stored index is searched where its chunks lie."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical as L
from siltstone.sources import stores


@pytest.mark.parametrize("held", [L.HELD, 100])
def test_best_chunks_leave_their_task_alone(spark, rows, tmp_path, held):
    """Ranks equal those of all scores, ties included; neither postings nor scores are shuffled, and the index is written once."""
    blank = [F.lit("").alias(c) for c in ("article", "clause", "link", "title", "text_raw")]
    word = lambda k: F.concat(F.lit(" w"), F.col("id") % k)
    chunks = spark.range(2000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.concat(F.lit("d"), F.col("id") % 9).alias("doc_id"), F.concat(F.lit("luật thuế"), word(7), word(31), word(5)).alias("text_norm"), F.when(F.col("id") % 3 == 0, "12/2020/tt").alias("legal_number"), *blank)
    q = spark.createDataFrame([("q", "luật w3 w4"), ("r", "thuế thuế w30 12/2020/tt"), ("s", "w1"), ("none", "vắng mặt"), ("null", None)], "query_id string, question string")
    terms = L.query_terms(q, "question")
    want = rows(L.cut_off(L.scores(L.build(chunks), terms), 1).select("query_id", "chunk_id", "doc_id", F.round("raw_score", 8), "chunk_rank"))
    bags = L.bagged(chunks)
    assert "Aggregate" not in bags._jdf.queryExecution().optimizedPlan().toString()
    stores.save_index(bags, f"file://{tmp_path}/i")
    got = L.top(stores.load_index(spark, f"file://{tmp_path}/i"), terms, 1, held=held)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert rows(got.select("query_id", "chunk_id", "doc_id", F.round("raw_score", 8), "chunk_rank")) == want and len(want) == 300


def test_search_writes_no_tokens_of_unasked_terms(spark, rows, monkeypatch):
    """A search splits a document's fields once a document, writes the numbers of asked terms alone, and its best chunks leave one task a query block."""
    docs = spark.createDataFrame([(f"d{i}", f"Luật thuế {i}", "12/2020/TT" if i % 2 else None, f"https://x/luat-thue-{i}.html", "2020", "Luật") for i in range(9)], "doc_id string, title string, legal_number string, link string, year string, doc_type string")
    blank = [F.lit("").alias(c) for c in ("article", "clause", "point", "text_raw")]
    chunks = spark.range(400).select(F.format_string("c%05d", "id").alias("chunk_id"), F.when(F.col("id") % 13 > 0, F.concat(F.lit("d"), F.col("id") % 11)).alias("doc_id"), F.concat(F.lit("luật w"), F.col("id") % 7, F.lit(" w"), F.col("id") % 31).alias("text_norm"), *blank)
    q = spark.createDataFrame([("q", "luật w3 w4"), ("r", "thuế thuế w30 12/2020/tt"), ("s", "w1"), ("none", "vắng mặt")], "query_id string, question string")
    for weights, tokens in ((L.FIELD_WEIGHTS, L.X.legal_tokens), (L.SEGMENTED_WEIGHTS, L.X.segmented_tokens)):
        terms = L.query_terms(q, "question", tokens)
        cols = ["query_id", "chunk_id", "doc_id", F.round("raw_score", 8), "chunk_rank"]
        want = rows(L.cut_off(L.scores(L.build(L.enriched(chunks, docs), weights, tokens), terms), 1).select(*cols))
        rich = L.enriched(chunks, docs, {"split": tokens})
        for often in (0.0, 2.0):  # all by matrices, and none
            monkeypatch.setattr(L, "OFTEN", often)
            got = rows(L.top(L.by_field(rich, weights, tokens, "split"), terms, 1).select(*cols))
            assert got == want and len(want) > 200
