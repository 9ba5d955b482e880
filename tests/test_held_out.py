"""What is tested out of fold reads no label of its own fold."""

import pytest

from siltstone.operators import learning as G
from siltstone.operators import ranking as R
from siltstone.plans import pipeline as O

FOLDS = [("a", 0), ("b", 0), ("c", 1), ("e", 2)]
RELEVANT = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("e", "3"), ("gone", "1")]


@pytest.fixture
def folds(spark):
    return spark.createDataFrame(FOLDS, "query_id string, fold long")


def relevant(spark, rows=RELEVANT):
    return spark.createDataFrame(rows, "query_id string, doc_id string")


def test_prior_of_the_other_folds(spark, folds):
    got = {(r["fold"], r["doc_id"]): r["train_doc_freq"] for r in G.fold_prior(relevant(spark), folds).collect()}
    for f in range(3):
        others = {q for q, g in FOLDS if g != f}
        for doc in "123":
            assert got[f, doc] == pytest.approx(sum(q in others and d == doc for q, d in RELEVANT) / len(others))


def test_features_do_not_read_their_own_labels(spark, folds):
    q = spark.createDataFrame([("a", "thời hạn thuê đất"), ("b", "mức lương tối thiểu vùng"), ("c", "thời hạn thuê đất"), ("e", "khác")], "query_id string, question string")
    static = spark.createDataFrame([(x, "bm25", "9", 1, 1.0) for x in "abce"], "query_id string, branch string, doc_id string, rank int, score double")

    def of(rows):
        rel = relevant(spark, rows)
        memory = O.fold_memory(q, q, rel, folds, O.Settings(memory_threshold=0.82)).drop("best_chunk_id")
        f = O.fold_features(R.fuse(static.unionByName(memory), top_k=30), q, rel, folds)
        return {(r["query_id"], r["doc_id"]): (r["memory_rank"], round(r["train_doc_freq"], 6)) for r in f.collect()}

    got = of(RELEVANT)
    # The equal question in another fold votes; its document counts in the prior of the other folds.
    assert got["a", "1"] == (1.0, 0.5) and got["c", "1"] == (1.0, 0.666667) and got["b", "9"] == (999.0, 0.0)
    other = of([r for r in RELEVANT if r != ("a", "1")] + [("a", "9")])
    assert {k: v for k, v in other.items() if k[0] in "ab"} == {k: v for k, v in got.items() if k[0] in "ab"}


def test_every_fold_is_boosted(spark):
    """As many queries as features, and a fold's scores do not follow its own labels."""
    rows = [(f"q{i % 15}", f"d{i}", i % 15 % 5, float(i % 7), int(i % 7 > 4)) for i in range(150)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, fold int, a double, label int")
    of = lambda x: {r["doc_id"]: (r["fold"], r["final_score"]) for r in G.cross_boosted(x, ["a"], rounds=2, depth=2).collect()}
    got = of(df)
    assert set(got) == {r[1] for r in rows} and {f for f, _ in got.values()} == set(range(5))
    other = of(df.selectExpr("query_id", "doc_id", "fold", "a", "if(fold = 0, 1 - label, label) as label"))
    assert all(other[k] == v for k, v in got.items() if v[0] == 0) and other != got


def test_queries_rank_every_candidate_query(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    run = lambda name: {r[0] for r in E.queries()[name](spark, sf).select("query_id").collect()}
    assert run("l03_boosted") == run("l12_features")
