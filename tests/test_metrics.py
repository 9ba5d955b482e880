import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import metrics as M


@pytest.fixture
def make(spark):
    def f(answers, gold):
        a = spark.createDataFrame(list(answers.items()), "query_id string, answer array<string>")
        return a, spark.createDataFrame([(q, d) for q, ds in gold.items() for d in ds], "query_id string, doc_id string")

    return f


@pytest.mark.parametrize(
    "answer, gold, recall, precision",
    [(["A", "B", "C"], ["A"], 1, 1 / 3), (["A", "B", "C", "D", "E", "F"], ["A"], 0, 0), ([], ["A"], 0, 0), (None, ["A"], 0, 0), (["A", "C"], ["A", "B"], 0.5, 0.5), (["A", "A"], ["A"], 1, 0.5), (["x"], ["A"], 0, 0)],
)
def test_golden(make, answer, gold, recall, precision):
    r = M.per_query(*make({"q": answer}, {"q": gold})).first()
    assert (r["recall"], r["precision"]) == pytest.approx((recall, precision))


def test_gains(make):
    r = M.per_query(*make({"q": ["x", "A", "B"]}, {"q": ["A", "B", "C"]})).first()
    assert r["mrr"] == 0.5 and r["map"] == pytest.approx((1 / 2 + 2 / 3) / 3)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert r["ndcg_at_5"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / ideal)
    assert (r["recall_at_1"], r["precision_at_3"]) == pytest.approx((0, 2 / 3))


def test_only_queries_with_gold_and_missing_answers(make):
    m = M.means(M.per_query(*make({"q1": ["A"], "q9": ["A"]}, {"q1": ["A"], "q2": ["B"]}))).first()
    assert m["n_queries"] == 2 and m["recall"] == 0.5
    assert M.means(M.per_query(*make({"q": ["A"]}, {}))).first()["n_queries"] == 0


def test_official(make):
    a, g = make({"q1": ["2", "9"], "q2": ["3"]}, {"q1": ["1", "2"], "q2": ["3"]})
    assert tuple(M.official(a, g).first()) == (0.75, 0.75)
    with pytest.raises(ValueError):
        M.official(a.limit(1), g)


@pytest.fixture
def pool(spark):
    rows = [("1", d, i) for i, d in enumerate("XAYB", 1)] + [("2", d, i) for i, d in enumerate("ZW", 1)]
    return spark.createDataFrame(rows, "query_id string, doc_id string, rank int"), spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "C"), ("2", "C"), ("2", None)], "query_id string, doc_id string")


def test_candidate_recall(pool):
    got = {r["cutoff"]: (r["recall"], r["any_hit"]) for r in M.candidate_recall(*pool, at=[2, 4, 4]).collect()}
    assert got == {2: (0.25, 0.5), 4: (0.5, 0.5)}
    assert [r[0] for r in M.misses(*pool, 4).collect()] == ["2"] and M.misses(*pool, 1).count() == 2
    c = M.ceilings(*pool).first()
    assert (c["ceiling"], c["oracle"], c["n_queries"]) == (1.0, 0.5, 2)
    for bad in ([0], [True], [1.5], [-3]):
        with pytest.raises(ValueError):
            M.cutoffs(bad)
    assert M.cutoffs([5, 3, 5]) == [5, 3]


def test_ceilings(spark):
    gold = spark.createDataFrame([("1", str(i)) for i in range(6)] + [("2", "a"), ("2", "b")], "query_id string, doc_id string")
    pool = spark.createDataFrame([("1", str(i)) for i in range(6)] + [("2", "a")], "query_id string, doc_id string")
    c = M.ceilings(pool, gold).first()
    assert c["ceiling"] == pytest.approx(11 / 12) and c["oracle"] == pytest.approx((5 / 6 + 1 / 2) / 2)


def test_folds_and_promotion(spark):
    f = spark.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, recall double")
    r = M.over_folds(f, ["recall"]).first()
    assert (r["mean"], r["std"]) == pytest.approx((0.6, 0.1))
    assert M.promoted({"recall@5": 0.7}, {"recall@5": 0.6})[0] and not M.promoted({"recall@5": 0.7, "candidate_recall@150": 0.5}, {"recall@5": 0.6})[0]
    assert M.promoted({"recall@5": 0.6, "precision@5": 0.2}, {"recall@5": 0.6, "precision@5": 0.1})[0] and not M.promoted({}, {})[0]


def test_violations(spark):
    docs = spark.sql("select * from values ('1', false), ('1', false), ('2', false), ('3', true) as v(doc_id, is_empty)")
    chunks = spark.sql("select * from values ('m1','1','macro',null), ('m2','2','macro',null), ('u1','1','micro','m2'), ('u2','1','micro','m9'), ('x','7','other',null) as v(chunk_id, doc_id, granularity, parent_chunk_id)")
    q = spark.sql("select * from values ('q1', 2), ('q2', 0) as v(query_id, gold_count)")
    r = spark.sql("select * from values ('q1','1',1), ('q1','1',1), ('q8','9',2) as v(query_id, doc_id, relevance)")
    got = {x["check_name"]: x["n"] for x in M.violations(docs, chunks, q, r).collect()}
    assert {k for k, n in got.items() if n} == {"repeated document", "unknown granularity", "chunk of unknown document", "missing parent", "parent in another document", "repeated judgement", "judgement of unknown query", "judgement of unknown document", "relevance other than 1"}


def test_answer_errors(spark):
    a = spark.createDataFrame([("1", ["a"]), ("2", []), ("3", ["a", "a"]), ("4", ["z"]), ("5", None), ("9", ["a", None])], "query_id string, answer array<string>")
    known, ids = spark.createDataFrame([("a",)], "doc_id string"), spark.createDataFrame([(str(i),) for i in range(1, 7)], "query_id string")
    got = {tuple(r) for r in M.answer_errors(a, ids, known).collect()}
    assert got == {("2", "wrong length"), ("3", "repeated document"), ("4", "unknown document"), ("5", "no list"), ("9", "null document"), ("9", "extra query"), ("6", "missing query")}
    assert {r["query_id"] for r in M.answer_errors(a, exact=2).filter("error = 'wrong length'").collect()} == {"1", "2", "4"}


def test_names_and_tolerances(spark):
    df = spark.createDataFrame([(1, "x", "macro", 7)], "document_id int, text string, chunk_level string, extra int")
    out = M.renamed(df, M.CHUNKS)
    assert {"doc_id", "text_raw", "granularity", "extra"} <= set(out.columns) and dict(out.dtypes)["doc_id"] == "string"
    a = spark.createDataFrame([("q", 1.0), ("r", 1.0), ("s", 1.0)], "k string, v double")
    b = a.filter("k != 's'").withColumn("v", F.when(F.col("k") == "q", 1.01).otherwise(1.5))
    assert {r["k"] for r in M.same_scores(a, b, ["k"], "v").collect()} == {"r", "s"}
