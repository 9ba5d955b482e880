import pytest
from pyspark.sql import functions as F

from siltstone.operators import lexical as L
from siltstone.operators import ranking as R


def test_weighted_fusion_golden(spark):
    r = spark.createDataFrame([("q", "bm25", "d", 1, 3.0), ("q", "dense", "d", 2, 0.5), ("q", "memory", "d", 2, 0.9), ("q", "exact", "d", 2, 1.0)], "query_id string, branch string, doc_id string, rank int, score double")
    got = R.fuse(r).first()
    assert got["rrf_score"] == pytest.approx(1 / 61 + 1.2 / 62 + 2.0 / 62 + 2.5 / 62)
    assert got["source_count"] == 4 and got["memory_rank"] == 2 and got["bm25_pyvi_rank"] is None
    assert R.weighted_rrf(r, {"bm25": 1.0}).first()["score"] == pytest.approx(1 / 61)


def test_branch_ranks_edges(spark):
    """Repeated documents, ties, null and non-finite scores, null keys, an extra column of a clashing name."""
    nan, inf = float("nan"), float("inf")
    rows = [("q", "b", "2", 1.0, 7), ("q", "b", "10", 1.0, 7), ("q", "b", "2", 0.5, 7), ("q", "b", "3", nan, 7), ("q", "b", "4", inf, 7), ("q", "b", "5", None, 7), (None, "b", "6", 1.0, 7), ("q", "b", None, 1.0, 7), ("q", "b", "7", -1.0, 7)]
    got = R.branch_ranks(spark.createDataFrame(rows, "query_id string, branch string, doc_id string, score float, rank int"), 2)
    assert [(r["doc_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [("10", 1), ("2", 2)]
    assert R.branch_ranks(spark.createDataFrame([], "query_id string, branch string, doc_id string, score float"), 2).count() == 0


def test_roll_up(spark):
    got = {r["doc_id"]: r for r in R.roll_up(spark.createDataFrame([("q", "a", "c1", 2.0), ("q", "a", "c2", 3.0), ("q", "a", "c3", 1.0), ("q", "b", "c4", 5.0)], "query_id string, doc_id string, chunk_id string, score double")).collect()}
    assert (got["a"]["score"], got["a"]["second_score"], got["a"]["mean_score"], got["a"]["best_chunk_id"]) == (3.2, 2.0, 2.0, "c2")
    assert (got["b"]["score"], got["b"]["second_score"]) == (5.0, 0.0)


def test_fuse_runs(spark):
    runs = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 0, 3, "a"), ("q", 1, 1, "b"), ("q", 1, 2, None)], "query_id string, run int, position int, doc_id string")
    got = {r["doc_id"]: r["rrf_score"] for r in R.fuse_runs(runs, n_runs=2).collect()}
    assert got == pytest.approx({"a": 0.5 / 61, "b": 0.5 / 62 + 0.5 / 61})


def test_chunk_policy(spark):
    s = spark.createDataFrame([("q", "c1", 1.0), ("q", "c2", 3.0), ("q", "c9", 9.0)], "query_id string, chunk_id string, score double")
    m = spark.createDataFrame([("c1", "d"), ("c2", "d")], "chunk_id string, doc_id string")
    assert R.chunks_to_documents(s, m, "mean").first()["score"] == 2.0 and R.chunks_to_documents(s, m).first()["score"] == 3.0
    with pytest.raises(ValueError):
        R.chunks_to_documents(s, m, "sum")


def test_final_sentinels(spark):
    rows = [("q", "a", 999.0, 1, None, None, 0.0, -999.0, 0.4), ("q", "b", None, None, None, None, 0.0, None, 0.7), ("q", "c", 1.0, None, None, None, 2.0, 0.0, 0.1), ("q", "d", None, None, None, None, 0.0, 60.0, 0.1)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, bm25_rank double, bm25_pyvi_rank int, dense_rank int, memory_rank int, exact_score double, reranker_score double, rrf_score double")
    got = {r["doc_id"]: r["final_score"] for r in R.final_rrf(df).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 0.7, "c": 1 / 61 + 2.5 * 0.05 * 2 + 2.5 * 0.05 * 0.5, "d": 2.5 * 0.05})


@pytest.fixture
def corpus(spark):
    chunks = [("c1", "d1", "văn bản nói về 12/2020/nđ-cp", "Điều 3", "Khoản 2", "Điểm a"), ("c2", "d2", "nội dung khác", "Điều 4", None, None), ("c3", None, "12/2020/nđ-cp", None, None, None), ("c4", "d4", None, None, None, None)]
    docs = [("d1", "Nghị định một", "9/1999/tt", "https://x/a-b", "2020", "Nghị định"), ("d2", "Nghị định hai", "12/2020/NĐ-CP", None, "2020", "Nghị định")]
    c = spark.createDataFrame([(a, b, "micro", t, t, x, y, z) for a, b, t, x, y, z in chunks], "chunk_id string, doc_id string, granularity string, text_raw string, text_norm string, article string, clause string, point string")
    return L.enriched(c, spark.createDataFrame(docs, "doc_id string, title string, legal_number string, link string, year string, doc_type string"))


def test_number_field_first(spark, corpus):
    q = spark.createDataFrame([("q", "nghị định 12/2020/NĐ-CP điều 4"), ("none", ""), ("null", None)], "query_id string, question string")
    got = L.search(corpus, q, "question", 5).collect()
    assert [r["doc_id"] for r in got if r["query_id"] == "q"][0] == "d2" and {r["query_id"] for r in got} == {"q"}


def test_weights_are_cut_to_whole_numbers(corpus):
    tf = {(r["chunk_id"], r["term"]): r["tf"] for r in L.build(corpus).postings.collect()}
    assert tf["c2", "12/2020/nđ-cp"] == 5 and tf["c2", "điều"] == 2 and tf["c1", "khoản"] == 1
    assert ("c4", "điều") not in tf


def test_boost_cannot_lift_a_chunk_over_the_cut(spark):
    s = spark.createDataFrame([("q", f"c{i:03d}", "d", 10.0 - i / 100) for i in range(150)], "query_id string, chunk_id string, doc_id string, raw_score double")
    cut = L.cut_off(s, 1)
    assert cut.count() == 100 and cut.agg(F.max("chunk_id")).first()[0] == "c099"


def test_boosts(spark, corpus):
    q = L.query_signals(spark.createDataFrame([("q", "Nghị định 9/1999 điều 3 khoản 2 điểm a năm 2020")], "query_id string, question string"), "question")
    cut = corpus.select("chunk_id", "doc_id").withColumns({"query_id": F.lit("q"), "raw_score": F.lit(1.0)})
    got = {r["chunk_id"]: r["boost"] for r in L.boosted(cut, corpus, q).collect()}
    assert got == {"c1": 6 + 3 + 1.5 + 0.75 + 1 + 1, "c2": 2.0, "c3": 0.0, "c4": 0.0}


def test_enriched_adds_what_is_absent_or_empty(spark, rows):
    from siltstone.operators import lexical as L

    docs = spark.createDataFrame([("d", "t", "1/2020", "l", "2020", "k", 1)], "doc_id string, title string, legal_number string, link string, year string, doc_type string, x int")
    chunks = spark.createDataFrame([("c", "d", "own", " "), ("e", "z", None, None)], "chunk_id string, doc_id string, Title string, link string")
    got = L.enriched(chunks, docs)
    assert sorted(c.lower() for c in got.columns) == ["chunk_id", "doc_id", "doc_type", "legal_number", "link", "title", "year"]
    assert rows(got.select("chunk_id", "title", "link", "year")) == [("c", "own", "l", "2020"), ("e", None, None, None)]
    assert L.enriched(chunks.limit(0), docs).count() == 0


def test_frequent_terms_are_spread_alike(spark, rows, monkeypatch):
    """Beyond the broadcast bound the scores stay what they are, with one term in every chunk."""
    from pyspark.sql import functions as F

    from siltstone.operators import lexical as L

    chunks = spark.range(3000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("d").alias("doc_id"), F.concat(F.lit("luật thuế "), F.col("id") % 7).alias("text_norm"), F.lit("").alias("text_raw"), *[F.lit("").alias(c) for c in ("article", "clause", "link", "title", "legal_number")])
    i = L.build(chunks)
    terms = L.query_terms(spark.createDataFrame([("q", "luật 3")], "query_id string, question string"), "question")
    a = rows(L.scores(i, terms).select("chunk_id", F.round("raw_score", 9)))
    monkeypatch.setattr(L, "BROADCAST_TERMS", 0)
    assert rows(L.scores(i, terms).select("chunk_id", F.round("raw_score", 9))) == a and len(a) == 3000
