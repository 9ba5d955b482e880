from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import structure as T

ACT = "Căn cứ luật\nChương I QUY ĐỊNH\nMục 1 Chung\nĐiều 1. Phạm vi\n1. Khoản một:\na) điểm a\nđ) điểm đ\n2. Khoản hai\nChương II KHÁC\nĐiều 2. Hiệu lực\nCó hiệu lực ngay."


def test_units():
    got = [(u.chapter, u.section, u.article, u.clause, u.point, u.text) for u in T.units(ACT)]
    assert got == [
        ("Chương I QUY ĐỊNH", "Mục 1 Chung", "Điều 1. Phạm vi", "Khoản 1", "Điểm a", "a) điểm a"), ("Chương I QUY ĐỊNH", "Mục 1 Chung", "Điều 1. Phạm vi", "Khoản 1", "Điểm đ", "đ) điểm đ"),
        ("Chương I QUY ĐỊNH", "Mục 1 Chung", "Điều 1. Phạm vi", "Khoản 2", None, "2. Khoản hai\nChương II KHÁC"), ("Chương II KHÁC", None, "Điều 2. Hiệu lực", None, None, "Có hiệu lực ngay."),
    ]
    assert T.units("") == T.units(None) == T.units("chỉ có chữ") == []


def test_article_rows():
    got = T.article_rows(ACT)
    # An article is closed by the next one, so a chapter heading between them already counts for it.
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("Chương II KHÁC", "Mục 1 Chung", "Điều 1. Phạm vi", "Khoản 2"), ("Chương II KHÁC", "Mục 1 Chung", "Điều 2. Hiệu lực", "")]
    assert T.article_rows("không có điều")[0][2] == T.WHOLE
    assert T.article_rows(None) == T.article_rows("  \n ") == []


def test_oversized_article():
    text = "Điều 1. Dài\n" + "Mỗi tổ chức phải nộp báo cáo hằng năm. " * 400
    rows = T.document_chunks("d", "Luật", "1/2020", text, False)
    macro = {r[0] for r in rows if r[2] == "macro"}
    assert all(r[11] <= 800 for r in rows if r[2] == "macro") and all(r[11] <= 250 for r in rows if r[2] == "micro")
    assert all(r[10] in macro for r in rows if r[2] == "micro") and len({r[0] for r in rows}) == len(rows)


def test_empty_document():
    for text, empty in ((None, False), ("x", True), ("  \n", None)):
        rows = T.document_chunks("d", None, None, text, empty)
        assert len(rows) == 1 and rows[0][2] == "macro" and rows[0][12] is True and rows[0][8] == ""


def test_preamble_and_fallback():
    rows = T.document_chunks("d", "T", None, "căn cứ " * 20 + "\nĐiều 1. A\nnội dung", False)
    assert [(r[0], r[5]) for r in rows] == [("d_macro_001", "Căn cứ ban hành"), ("d_micro_001_01", "Căn cứ ban hành"), ("d_macro_002", "Điều 1. A"), ("d_micro_002_01", "Điều 1. A")]
    rows = T.document_chunks("d", "T {x}", None, "từ " * 3000, False)
    assert sum(r[2] == "macro" for r in rows) == 3 and rows[0][5] == "Đoạn 1" and rows[1][6] == "Đoạn nhỏ 1"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.integers(2, 60), st.integers(0, 59))
def test_windows(n, size, overlap):
    overlap %= size
    got = T.windows([str(i) for i in range(n)], size, overlap)
    assert [w for w in got if not w or len(w) > size] == [] and (not n or got[-1][-1] == str(n - 1))
    assert all(a[-overlap:] == b[:overlap] for a, b in zip(got, got[1:])) if overlap else True


def test_window_expression(spark):
    n = spark.range(0, 700).select(F.col("id").cast("int").alias("n"))
    for r in n.select("n", T.window_spans(F.col("n"), 300, 50).alias("w")).collect():
        want = T.windows(list(range(r["n"])), 300, 50)
        assert [(x["first"], x["n_words"]) for x in r["w"]] == [(w[0], len(w)) for w in want]


def test_frames(spark):
    docs = spark.createDataFrame([("1", "T", None, ACT, False), ("2", None, None, None, True)], "doc_id string, title string, legal_number string, text string, is_empty boolean")
    assert T.legal_units(docs).count() == 4 and T.articles(docs).count() == 2
    c = T.chunked(docs)
    assert c.filter("granularity = 'macro'").count() == 3
    micro, macro = c.filter("granularity = 'micro'"), c.filter("granularity = 'macro'")
    assert micro.join(macro.select(F.col("chunk_id").alias("parent_chunk_id")), "parent_chunk_id", "left_anti").count() == 0
    assert T.chunked(docs.limit(0)).count() == 0
