import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import encode as E

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    t = tokenizers.Tokenizer.from_file(f"{E.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def texts():
    r = random.Random(2)
    odd = [None, "", " ", "  \n\t ", "  x　", "<|endoftext|> a", "I'm you'll 's", "a" * 700, "ab" * 900, "-" * 500, "Điều 1.\r\n  Khoản", "😀👩‍👩‍👧 é é", "x​y﻿", "ﬁ½²Ⅳ", " " * 300 + "z", "\x00\x01", "한국어 ไทย עברית", "word " * 20_000]
    made = ["".join(r.choice("abc đếúợ 01.,'-\n\t ") for _ in range(r.randint(1, 80))) for _ in range(300)]
    return odd + made + ["lặp lại"] * 50


def test_ids_equal_the_library(spark, tokenizer):
    data = [(i if i != 5 else None, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "doc_id long, text string, word string").withColumn("ids", F.lit("clash"))
    got = E.encode(df, "text").collect()
    assert len(got) == len(data)
    want = sorted((str(i), tokenizer(t)) for i, t, _ in data)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want


def test_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in texts() if t is not None], "text string")
    assert E.encode(df, "text").withColumn("back", E.decode(F.col("ids"))).filter("back != text").count() == 0


def test_words_outside_the_frequent_ones(spark, tokenizer, monkeypatch):
    """With hardly any frequent words nearly all are folded where they stand, with the same result."""
    monkeypatch.setattr(E, "FREQUENT", 3)
    data = [(i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: list(r["ids"]) for r in E.encode(spark.createDataFrame(data, "doc_id long, text string"), "text").collect()}
    assert got == {i: tokenizer(t) for i, t in data}


def test_fold_and_heap_agree(spark):
    words = sorted({w for t in texts() if t for w in t.split()} | {"q" * 255})
    tokens, pairs = E.vocabulary(f"{E.FOLDER}/byte_bpe_50k.tiktoken")
    at = {t: i for i, t in enumerate(tokens) if len(t) == 1}
    byte_ids = [at[bytes([x])] for x in range(256)]
    words = [w for w in words if len(w.encode()) <= E.LONG]
    got = spark.createDataFrame([(w,) for w in words], "word string").withColumn("ids", E.folded(F.col("word"), f"{E.FOLDER}/byte_bpe_50k.tiktoken")).collect()
    assert {r["word"]: list(r["ids"]) for r in got} == {w: E.heap_merges(w.encode(), byte_ids, pairs) for w in words}


def test_plan_moves_no_text(spark, monkeypatch):
    """Without broadcasts the pass over the texts has no exchange and no join; a text of many rare words is not quadratic."""
    monkeypatch.setattr(E, "FREQUENT", 3)
    r = random.Random(3)
    big = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20_000))
    df = spark.createDataFrame([(1, big), (2, "một hai")], "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = E.encode(df, "text")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert out.withColumn("back", E.decode(F.col("ids"))).join(df.withColumnRenamed("text", "t"), "doc_id").filter("back != t").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_plans_name_the_vocabulary_only(spark):
    """The driver keeps and logs the text of every plan: none spells out the rank map or the frequent words, and no row holds them."""
    def kept():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        rows = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {x.executionId(): len(x.physicalPlanDescription()) for x in map(rows.apply, range(rows.size()))}

    before = kept()
    out = E.encode(spark.createDataFrame([(1, "một hai " + "x" * 300), (2, "ba")], "doc_id long, text string"), "text")
    out.write.format("noop").mode("overwrite").save()
    sizes = [n for k, n in kept().items() if k not in before]
    assert sizes and max(sizes) < 100_000
    assert "_value" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.encode(df, "text").count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [list(r["ids"]) for r in E.encode(only, "text").collect()] == [[], []]
