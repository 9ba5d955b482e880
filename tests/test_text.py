import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X


@pytest.fixture
def one(spark):
    return lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*[F.col(f"c{i}") for i in range(len(v))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (X.clean, "  Điều 1\u00a0 \n“a”  ‘b’\t", "Điều 1 \"a\" 'b'"), (X.clean, "e\u0301", "é"), (X.clean, None, ""), (X.clean, "", ""),
        (X.block, " a \t b\n \n\nc ", "a b\nc"), (X.folded, " Luật  Đất ", "luật đất"), (X.question, "Luật 12/2020, điều 3?!", "luật 12/2020 điều 3"),
        (X.unaccented, "Nghị-định_Đất/đai", "nghi dinh dat dai"), (X.unaccented, None, ""), (X.pretty_title, "Nghi-dinh-15-2020-ND-CP-123456", "Nghị định 15/2020/NĐ-CP"),
        (X.pretty_title, "Thong-tu-3-2019-TT-BTC", "Thông tư 3/2019/TT-BTC"), (X.pretty_title, "van-ban-khac", "van ban khac"), (X.pretty_title, "None", ""),
        (X.slug, "https://a.example/x/nghi-dinh-1/", "nghi-dinh-1"), (X.dense_text, " a\n b ", "a b"),
        (X.legal_tokens, "Nghị định 123/2020/NĐ-CP và 61/2020/QH14", ["nghị", "định", "123/2020/nđ-cp", "và", "61/2020/qh14"]), (X.legal_tokens, None, []),
        (X.word_tokens, "Một_hai, ba!", ["một_hai", "ba"]), (X.token_set, "a-b a-b -c- d/e", ["a-b", "c", "d/e"]),
    ],
)
def test_values(one, f, given, want):
    assert one(f, given) == want


def test_signals(one):
    got = one(X.signals, "Theo Điều 5a khoản 2 điểm đ, ĐIỂM b và Điều 5a Nghị định 12/2020/NĐ-CP năm 2021; 2021 và 1999, 15/2020.")
    assert got["articles"] == ["5a"] and got["clauses"] == ["2"] and got["points"] == ["b"]
    assert got["doc_numbers"] == ["12/2020/NĐ-CP", "15/2020"] and got["years"] == ["2020", "2021", "1999"]


@pytest.mark.parametrize("n, want", [(30, "abcdefghij klmnopqrst uvwxyz"), (20, "abcdefghij..."), (10, "abcdefg..."), (3, "abc"), (16, "abcdefghij...")])
def test_truncated(one, n, want):
    assert one(lambda c: X.truncated(c, F.lit(n)), "abcdefghij klmnopqrst uvwxyz") == want


def test_metadata(one):
    m = one(X.metadata, "7", "Nghi-dinh-15-2020-12345", None, "Số: 12/2021/NĐ-CP ngày 3 năm 2021. NGHỊ ĐỊNH về đất")
    assert (m["title"], m["legal_number"], m["year"], m["doc_type"]) == ("Nghi dinh 15 2020", "12/2021/NĐ-CP", "2021", "Nghị định")
    m = one(X.metadata, "7", None, "https://x/luat-dat-dai-99", None)
    assert (m["title"], m["legal_number"], m["year"], m["doc_type"]) == ("luat dat dai", None, None, "Văn bản")
    assert one(X.metadata, "7", None, None, None)["title"] == "Văn bản pháp luật 7"


def test_numbers(spark):
    df = spark.createDataFrame([(v,) for v in (None, "x", "1.5", "NaN", "Infinity")], "c string")
    assert [r[0] for r in df.select(X.safe_number(F.col("c"), -1.0)).collect()] == [-1, -1, 1.5, -1, -1]
    got = [r[0] for r in spark.createDataFrame([(0.0,), (60.0,), (-60.0,), (2.0,)], "c double").select(X.sigmoid(F.col("c"))).collect()]
    assert got[:3] == [0.5, 1.0, 0.0] and math.isclose(got[3], 1 / (1 + math.exp(-2)))
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],)], "v array<float>").select(X.unit_vector(F.col("v"))).collect()
    assert [list(r[0]) for r in v] == [[0.6, 0.8], [0.0, 0.0], []]


def test_present(spark):
    df = spark.createDataFrame([(v,) for v in (None, " ", "NaN", "null", "NaT", "none", " x ")], "c string")
    assert [r[0] for r in df.select(X.shown(F.col("c"), "-")).collect()] == ["-"] * 6 + ["x"]
