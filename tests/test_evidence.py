import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import evidence as E
from siltstone.operators import rerank as K

CHUNK = "doc_id string, chunk_id string, article string, clause string, point string, text_raw string, text_norm string"


@pytest.fixture
def score(spark):
    def f(question, chunks, prior=None, training=False):
        c = spark.createDataFrame(chunks, CHUNK)
        q = spark.createDataFrame([("q", question)], "query_id string, question string")
        cand = c.select("doc_id").distinct().withColumns({"query_id": F.lit("q"), "prior_chunk_id": F.lit(prior).cast("string")})
        return E.scored_chunks(cand, q, c, training)

    return f


def test_tiers(score):
    base = ("d", None, None, None, None)
    chunks = [("d", "c1", "Điều 5. Tên", None, None, "nội dung", None), ("d", "c2", None, None, None, "x " * 700 + "theo điều 5 này", None), ("d", "c3", "", "", "", "", ""), ("d", "c4", "none", None, None, None, "khoản 2 điểm b 12/2020/nđ-cp 2021")]
    got = {r["chunk_id"]: r["score"] for r in score("Điều 5 khoản 2 điểm b 12/2020/NĐ-CP năm 2021", chunks, "c3").collect()}
    overlap = 1 + math.log(2 + 1) + (1 + math.log(2 + 1))
    assert got["c1"] == pytest.approx(20 + 2 * overlap / (math.sqrt(2) + 1))
    assert got["c2"] >= 12 and got["c3"] == 5.0
    assert got["c4"] > 8 + 4 + 6 + 1.5 and base
    train = {r["chunk_id"]: r["score"] for r in score("Điều 5 khoản 2 điểm b 12/2020/NĐ-CP năm 2021", chunks, "c3", True).collect()}
    assert train["c3"] == 0.0 and train["c4"] < got["c4"]


def test_complementary_choice(score):
    """Alike chunks are passed over, wordless ones skipped, and both fill up when too few are left."""
    t = " ".join(f"w{i}" for i in range(20))
    chunks = [("d", "a", None, None, None, "hỏi " + t, None), ("d", "b", None, None, None, "hỏi " + t, None), ("d", "c", None, None, None, "khác hẳn", None), ("d", "e", None, None, None, "", None), ("one", "z", None, None, None, "", None)]
    s = score("hỏi w1 w2", chunks)
    ids = lambda n: {r["doc_id"]: [c["chunk_id"] for c in r["chunks"]] for r in E.selected(s, n).collect()}
    assert ids(2) == {"d": ["a", "c"], "one": ["z"]}
    assert ids(4)["d"] == ["a", "c", "b", "e"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("d", "Luật Đất đai", "luat", "31/2024"), ("n", None, "ten-file", "nan")], "doc_id string, title string, name_raw string, legal_number string")


def chosen(spark, bodies, doc="d"):
    rows = [(f"c{i}", f"Điều {i}", "", "", b, 1.0) for i, b in enumerate(bodies)]
    return spark.createDataFrame([("q", doc, rows)], "query_id string, doc_id string, chunks array<struct<chunk_id:string,article:string,clause:string,point:string,body:string,score:double>>")


def test_budget(spark, docs):
    long = "từ ngữ " * 400
    p = E.packs(chosen(spark, [long, long, long]), docs, 1000).first()["pack"]
    head = "[DOCUMENT] Luật Đất đai 31/2024"
    room = 1000 - len(head) - 45
    parts = p.split("[EVIDENCE ")
    assert p.startswith(head + " [EVIDENCE 1] ")
    assert len(parts[1].strip()[3:]) <= int(room * 0.6) and all(len(x.strip()[3:]) <= int(room * 0.2) for x in parts[2:]) and p.endswith("...")
    assert len(E.packs(chosen(spark, [long]), docs, 60).first()["pack"]) <= len(head) + 15 + 100
    t = E.packs(chosen(spark, ["từ " * 300]), docs, 5000, max_tokens=50).first()["pack"]
    assert len(t.split()) <= 45 and len(t) <= 200 + 45
    a = E.packs(chosen(spark, ["nội dung"]), docs, article_prefix=True).first()["pack"]
    assert a.endswith("[EVIDENCE 1] Điều 0: nội dung")


def test_no_chunks_and_names(spark, docs):
    assert E.packs(chosen(spark, [], "n"), docs).first()["pack"] == "[DOCUMENT] ten-file [EVIDENCE 1] Văn bản pháp luật n"
    assert E.packs(chosen(spark, [], "x"), docs).first()["pack"] == "[DOCUMENT] Văn bản x [EVIDENCE 1] Văn bản pháp luật x"
    assert E.lines(chosen(spark, ["a", "Điều 1 b"]), docs).first()["text"] == "[DOCUMENT] Luật Đất đai 31/2024\n[EVIDENCE 1] Điều 0: a\n[EVIDENCE 2] Điều 1 b"
    r = E.records(E.packs(chosen(spark, ["a", "b"]), docs), docs).orderBy("n").collect()
    assert r[0]["text"].startswith(r[0]["pack"] + " [VĂN BẢN]: Luật Đất đai (Số: 31/2024)") and r[1]["text"] == r[1]["pack"] and r[1]["reranker_text"].endswith("[EVIDENCE 1] b")


def test_reranking(spark):
    cand = spark.createDataFrame([("q", str(i), i) for i in range(1, 6)], "query_id string, doc_id string, rank int")
    pairs = spark.createDataFrame([("q", "1", "a", 1.0), ("q", "2", "b", 3.0), ("q", "2", "c", 5.0), ("q", "5", "d", 9.0)], "query_id string, doc_id string, chunk_id string, pair_score double")
    d = {r["doc_id"]: r for r in K.by_document(pairs).collect()}
    assert (d["2"]["reranker_score"], d["2"]["reranker_second_score"], d["2"]["reranker_margin"], d["2"]["reranker_best_chunk_id"]) == (5, 3, 2, "c")
    assert (d["1"]["reranker_second_score"], d["1"]["evidence_chunk_count"]) == (1, 1)
    got = [(r["doc_id"], r["reranker_score"]) for r in K.reranked(cand, K.by_document(pairs), 3).orderBy("rerank_rank").collect()]
    assert got == [("2", 5.0), ("1", 1.0), ("3", 0.0), ("4", -999.0), ("5", -999.0)]


def test_scorers(spark):
    df = spark.createDataFrame([("Luật ĐẤT đai", "đất đai xanh", 1), (None, "a", 2), ("a a b", "a", 3)], "question string, passage string, k int")
    assert [r[0] for r in df.select(K.shared_words(F.col("question"), F.col("passage"))).collect()] == [2, 0, 1]
    got = {r["k"]: r["pair_score"] for r in K.scored_by(df, lambda q, p: [float(len(x)) for x in p]).collect()}
    assert got == {1: 12.0, 2: 1.0, 3: 1.0}
    m = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("y", 0, 1.0)], "k string, member int, pair_score double")
    assert {r["k"]: r["pair_score"] for r in K.ensemble(m, ["k"], 2).collect()} == {"x": 1.5, "y": None}
    with pytest.raises(ValueError):
        K.ensemble(m, ["k"], 1)


def test_answers(spark):
    r = spark.createDataFrame([("q", d, i) for i, d in enumerate(["a", "b", "a", " ", "c", "e", "f", "g"], 1)] + [("r", "zz", 1)], "query_id string, doc_id string, rank int")
    got = {x["query_id"]: x["answer"] for x in K.answers(r).collect()}
    assert got == {"q": ["a", "b", "c", "e", "f"], "r": ["zz"]}
    valid = spark.createDataFrame([(x,) for x in "abc"], "doc_id string")
    got = {x["query_id"]: x["answer"] for x in K.answers(r, 5, 3, ["c", "nope"], valid).collect()}
    assert got == {"q": ["a", "b", "c"], "r": ["c", "a", "b"]}
    for bad in ((0, None), (6, None), (2, 3)):
        with pytest.raises(ValueError):
            K.answers(r, *bad)
    assert X.present is not None


def test_candidate_table(spark):
    t = spark.createDataFrame([("q", "đất đai", "a", "đất đai rộng"), ("q", "đất đai", "b", "khác")], "qid string, query_text string, document_id string, text string")
    rel = spark.createDataFrame([("q", "a")], "query_id string, doc_id string")
    state, m = K.evaluated_table(t, rel)
    assert state == "PASS" and m.first()["hit1"] == 1.0
    assert K.evaluated_table(t.drop("text"), rel) == ("BLOCKED", ["passage"])
