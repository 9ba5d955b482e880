import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import learning as G
from siltstone.operators import memory as M
from siltstone.operators import vectors as V


@pytest.fixture
def table(spark):
    r = np.random.default_rng(1)
    rows = [(f"q{i % 30}", f"d{i}", int(i % 30 % 5), *map(float, r.normal(size=3)), int(r.random() < 0.3)) for i in range(400)]
    return spark.createDataFrame(rows, "query_id string, doc_id string, fold int, a double, b double, c double, label int"), rows


def closed(rows, alpha=1.0):
    x, y = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows], float)
    xm, ym = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xm.T @ xm + alpha * np.eye(3), xm.T @ ym)
    return w, y.mean() - x.mean(0) @ w


def test_ridge(table):
    df, rows = table
    m = G.Ridge(["a", "b", "c"]).fit(df)
    w, b = closed(rows)
    assert m.coefficients == pytest.approx(w, abs=1e-10) and m.intercept == pytest.approx(b, abs=1e-10)
    again = G.Ridge.from_json(m.to_json())
    assert again.coefficients.tolist() == m.coefficients.tolist() and again.columns == m.columns
    assert G.Ridge(["a"]).fit(df.limit(0)).coefficients.tolist() == [0.0]


def test_cross_fitting_uses_other_folds_only(table):
    df, rows = table
    got = {r["doc_id"]: r["final_score"] for r in G.cross_fitted(df, ["a", "b", "c"]).collect()}
    for f in range(5):
        w, b = closed([r for r in rows if r[2] != f])
        for r in rows:
            if r[2] == f:
                assert got[r[1]] == pytest.approx(np.array(r[3:6]) @ w + b, abs=1e-9)
    # A changed label leaves the scores of its own fold as they are.
    other = {r["doc_id"]: r["final_score"] for r in G.cross_fitted(df.withColumn("label", F.when(F.col("doc_id") == "d0", 1 - F.col("label")).otherwise(F.col("label"))), ["a", "b", "c"]).collect()}
    assert all((abs(other[r[1]] - got[r[1]]) < 1e-12) == (r[2] == 0) for r in rows)
    with pytest.raises(ValueError):
        G.cross_fitted(df.filter("fold = 0"), ["a"])


def test_feature_defaults(spark):
    c = spark.createDataFrame([("q", "d", None, float("nan"), 2.0, True), ("q", "e", 3, 1.5, float("inf"), None)], "query_id string, doc_id string, bm25_rank int, bm25_score double, dense_score double, exact_title boolean")
    got = {r["doc_id"]: r for r in G.features(c).collect()}
    d, e = got["d"], got["e"]
    assert (d["raw_bm25_rank"], d["raw_bm25_score"], d["bm25_inv_rank"], d["exact_title_overlap"], d["reranker_score"], d["source_count"]) == (999.0, 0.0, 0.0, 1.0, -999.0, 1.0)
    assert (e["raw_bm25_rank"], e["dense_score"], e["dense_margin"], e["memory_rank"], e["label"]) == (3.0, 0.0, 0.0, 999.0, 0)
    assert e["bm25_inv_rank"] == 1 / 63 and d["dense_margin"] == 2.0 and len(d) == 2 + 42 + 1


def test_prior_and_winner(spark):
    rel = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q2", "a"), ("q2", "b"), ("q2", None)], "query_id string, doc_id string")
    assert {r["doc_id"]: r["train_doc_freq"] for r in G.document_prior(rel).collect()} == {"a": 1.0, "b": 0.5}
    assert G.winner({"recall": 0.5, "precision": 0.1}, {"recall": 0.5, "precision": 0.1}) == "fixed" and G.winner({"recall": 0.5, "precision": 0.2}, {"recall": 0.5, "precision": 0.1}) == "learned"


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1.0, 2.0, -1.0, [2.0, 0.0, 1.0]), (-800.0, 0.0, 0.0, 0.5, [0.0])], "logit double, label double, pos double, neg double, scores array<double>")
    a, b = df.select(*[c.alias(k) for k, c in G.losses().items()]).collect()
    assert (a["bce"], a["pairwise_logistic"], a["pairwise_margin"]) == pytest.approx((math.log1p(math.exp(-2)), math.log1p(math.exp(-3)), 0.0))
    assert a["listwise"] == pytest.approx(math.log(math.exp(2) + 1 + math.exp(1)) - 2) and (b["bce"], b["pairwise_margin"], b["listwise"]) == (0.0, 1.5, 0.0)


def grams(text, low=3, high=5):
    out = []
    for w in text.split():
        w = f" {w} "
        for n in range(low, high + 1):
            got = [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            out += got
            if len(w) <= n:
                break
    return out


def test_word_grams(spark):
    for t in ("a", "ab", "abc", "abcd abcde  x", "", "một hai"):
        got = spark.createDataFrame([(t,)], "t string").select(M.word_grams(F.col("t"))).first()[0]
        assert sorted(got) == sorted(grams(t))


@pytest.mark.parametrize("threshold", [0.3, 0.82])
def test_similarity_join_against_all_pairs(spark, threshold):
    import random
    from collections import Counter

    r = random.Random(5)
    texts = [" ".join(r.choice(["thuế", "đất", "đai", "phạt", "nộp", "hồ", "sơ", "giấy", "phép"]) for _ in range(r.randint(2, 9))) for _ in range(60)] + ["", "thuế đất", "thuế đất"]
    ids = [f"{i:02d}" for i in range(len(texts))]
    tf = {i: Counter(grams(t)) for i, t in zip(ids, texts)}
    n, df = len(ids), Counter(g for c in tf.values() for g in c)
    vec = {i: {g: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in c.items()} for i, c in tf.items()}
    for v in vec.values():
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        for g in v:
            v[g] /= length
    want = {(a, b) for a in ids for b in ids if a != b and sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) >= threshold}
    q = spark.createDataFrame(list(zip(ids, texts)), "query_id string, text string")
    got = {(x["query_id"], x["train_id"]) for x in M.similar(q, q, threshold).collect()}
    assert len(want) > 1 and got == want


def test_votes(spark):
    p = spark.createDataFrame([("q", "t1", 0.9), ("q", "t2", 0.95)], "query_id string, train_id string, lexical double")
    rel = spark.createDataFrame([("t1", "d"), ("t2", "d"), ("t2", "e")], "query_id string, doc_id string")
    d, e = M.votes(p, rel, 4).orderBy("rank").collect()
    assert (d["doc_id"], d["vote_count"], d["matched_id"], d["positive_frequency"]) == ("d", 2, "t2", 0.5) and d["score"] == pytest.approx(1.85) and e["score"] == 0.95


@pytest.mark.parametrize("block", [2048, 3])
def test_vector_search(spark, block):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(90, 6)), 1)
    x[5] = x[6]
    base = spark.createDataFrame([(f"{i}", [float(v) for v in row]) for i, row in enumerate(x)] + [("bad", [float("nan")] * 6), (None, [0.0] * 6), ("null", None)], "id string, v array<double>")
    q = base.filter("id in ('0', '5', '17', '33', '60', '71', 'bad')")
    got = {}
    for a in V.nearest(q, base, 4, block).orderBy("query_id", "chunk_rank").collect():
        got.setdefault(a["query_id"], []).append(a["chunk_id"])
    assert set(got) == {"0", "5", "17", "33", "60", "71"}
    for k, ids in got.items():
        s = x @ x[int(k)]
        assert ids == [i for _, i in sorted((-round(float(v), 9), str(i)) for i, v in enumerate(s))[:4]]
    assert V.nearest(q.limit(0), base, 4).count() == 0


def test_boosted_and_matrix(table, spark):
    df, rows = table
    easy = df.withColumn("label", (F.col("a") > 0).cast("int"))
    got = G.boosted_ranker(easy, ["a", "b"], rounds=5, depth=3)(easy)
    top = got.filter("final_rank <= 3").agg(F.avg("label")).first()[0]
    assert top > 0.95
    c = spark.createDataFrame([("q", "d", 2, None, 0.5)], "query_id string, doc_id string, source_count int, bm25_rank int, bm25_score double")
    assert tuple(G.union_matrix(c, spark.createDataFrame([("q", "d")], "query_id string, doc_id string")).first()) == ("q", "d", 2, 999, 0.5, 1)
    assert G.parameter_budget({"a": 134_998_272, "b": 567_755_777}) == (702_754_049, True) and G.projected_seconds(10, 5, 10, 2) == 18


def test_encoder_hook(spark):
    t = spark.createDataFrame([("1", "abc"), ("2", None), ("3", "a")], "id string, text string")
    got = {r["id"]: r["v"] for r in V.encoded(t, lambda x: [[3.0 * len(s), 4.0 * len(s)] for s in x]).collect()}
    assert got["1"] == pytest.approx([0.6, 0.8]) and got["2"] == [0.0, 0.0]


def test_folds_do_not_see_their_own_questions(spark):
    """A question that joins a fold leaves the similarities of its own fold's questions unchanged."""
    texts = [(str(i), t, i % 2) for i, t in enumerate(["thuế đất ở", "thuế đất ở đô thị", "thuế đất", "nộp thuế đất ở", "phạt nộp chậm", "thuế đất ở nông thôn"])]
    make = lambda rows: spark.createDataFrame(rows, "query_id string, text string, fold int")

    def run(rows):
        q = make(rows)
        train = q.select("query_id", "text", F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda p: p != F.col("fold"))).alias("part"))
        return {(r["query_id"], r["train_id"]): r["lexical"] for r in M.similar(q.withColumnRenamed("fold", "part"), train, 0.1).collect()}

    before, after = run(texts), run([*texts, ("9", "thuế thuế đất", 0)])
    assert before and all((int(a) + int(b)) % 2 for a, b in before)
    assert {k: v for k, v in after.items() if int(k[0]) % 2 == 0 and k[0] != "9"} == pytest.approx({k: v for k, v in before.items() if int(k[0]) % 2 == 0})


def test_selection_gate(spark, table):
    """The better pooled recall wins; declared beforehand, fixed fusion is taken and nothing is fitted."""
    df, rows = table
    names = ["raw_bm25_rank", "pyvi_bm25_rank", "dense_rank", "memory_rank"]
    f = df.withColumns({n: F.lit(999.0) for n in names} | {"exact_score": F.lit(0.0), "reranker_score": F.lit(-999.0), "rrf_score": F.rand(3), "a": F.col("label") + F.rand(5) / 10})
    rel = f.filter("label = 1").select("query_id", "doc_id")
    name, ranked, pooled = G.gated(f, ["a", "b", "c"], rel)
    assert name == "learned" and pooled["learned"]["recall"] > pooled["fixed"]["recall"] and ranked.count() == 400
    name, ranked, pooled = G.gated(f, ["a", "b", "c"], rel, predeclared=True)
    assert name == "fixed" and list(pooled) == ["fixed"] and ranked.count() == 400
