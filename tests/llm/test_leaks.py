import random

import pytest

from siltstone.llm import leaks as L


def brute(docs, items, least):
    """The longest common run of words of every pair, if long enough."""
    out = set()
    for i, d in docs:
        a = L.words_of(d or "")
        for j, t in items:
            b, best = L.words_of(t or ""), 0
            last = [0] * (len(b) + 1)
            for x in a:
                now = [0] * (len(b) + 1)
                for k, y in enumerate(b):
                    if x == y:
                        now[k + 1] = last[k] + 1
                        best = max(best, now[k + 1])
                last = now
            if best >= least:
                out.add((i, j, best))
    return out


def data(seed=1):
    r = random.Random(seed)
    word = lambda: r.choice(["một", "hai", "ba", "bốn", "năm", "sáu"])
    items = [(j, " ".join(word() for _ in range(r.randint(3, 25)))) for j in range(12)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(r.randint(0, 40))]
        if i % 2:
            t = L.words_of(r.choice(items)[1])
            cut = t[r.randint(0, len(t) // 2) :]
            at = r.randint(0, len(text))
            text[at:at] = cut
        docs.append((i, " ".join(text)))
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_longest_runs_against_brute_force(spark, block_bytes):
    docs, items = data()
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 6, block_bytes)
    found = {(r["doc_key"], r["item_id"], r["n_words"]) for r in got.collect()}
    want = brute(docs, items, 6)
    assert len(want) > 20 and found == want
    words = {i: L.words_of(t) for i, t in docs}, {j: L.words_of(t) for j, t in items}
    for r in got.collect():
        a, b = words[0][r["doc_key"]][r["doc_word"] :], words[1][r["item_id"]][r["item_word"] :]
        assert a[: r["n_words"]] == b[: r["n_words"]]


ITEM = "Cơ quan thuế phải công khai danh mục số 12 trước ngày 5 hằng năm tại trụ sở"


def test_what_does_not_matter(spark):
    """Case, punctuation, line breaks, invisible characters and the encoding of accents do not matter; accents do."""
    import unicodedata

    same = [ITEM.upper(), ITEM.replace(" ", "\n -- "), unicodedata.normalize("NFD", ITEM), ITEM.replace("công", "c​ô­ng"), "x " * 5000 + ITEM + " y" * 5000]
    other = ["Co quan thue phai cong khai danh muc so 12 truoc ngay 5 hang nam tai tru so", " ".join(ITEM.split()[:11]), None, "", "​", "một"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*same, *other, same[0]])] + [(None, ITEM, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, "x"), (7, ITEM, "x"), (8, None, "x"), (9, "", "x"), (None, ITEM, "x"), (10, "ngắn quá", "x")], "item_id long, text string, doc_key string")
    got = L.leaks(docs, "doc_id", "text", items, "item_id", "text")
    assert {(r["doc_key"], r["item_id"]) for r in got.collect()} == {(i, 7) for i in (0, 1, 2, 3, 4, 11, None)}
    assert sorted(r[0] for r in L.without_leaks(docs, "doc_id", got).select("doc_id").filter("doc_id is not null").collect()) == [5, 6, 7, 8, 9, 10]


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert L.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert L.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_a_passage_in_a_third_of_all_documents(spark):
    docs = spark.createDataFrame([(i, ITEM if i % 3 == 0 else f"tài liệu {i}") for i in range(3000)], "doc_id long, text string")
    assert L.leaks(docs, "doc_id", "text", spark.createDataFrame([(1, ITEM)], "item_id long, text string"), "item_id", "text").count() == 1000
