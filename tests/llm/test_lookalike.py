import duckdb
import pytest

from siltstone.llm import lookalike as A


@pytest.mark.parametrize(
    "given, want",
    [
        ("Ｄｉều　１", "Diều 1"), ("сhủ độnɡ", "chủ động"), ("é​e", "ée"), ("а́", "á"), ("  a  b\r\n", "a b"), ("m²", "m²"), ("Hòa", "Hòa"), ("Hoà", "Hoà"), ("x­y", "xy"),
        ("Ðiều", "Điều"), ("ﬁn Ⅳ", "fin IV"), ("a‑b", "a-b"), ("a–b", "a–b"), ("​﻿ ", ""), ("", ""), ("ё", "ë"), ("ΑΒΕ", "ABE"), ("ộ", "ộ"), ("ộ", "ộ"), ("ὰ", "à"),
    ],
)
def test_form(given, want):
    assert duckdb.execute(f"SELECT {A.form_sql('c')} FROM (SELECT ?::VARCHAR AS c)", [given]).fetchone()[0] == want


@pytest.mark.parametrize("given, want", [("𝐀𝒃𝟏", "Ab1"), ("ℎ", "h"), ("\u00b5", "\u03bc"), ("ᎠᎪ", "DA"), ("ᴄᴏᴠᴡᴢ", "covwz"), ("ⲞⲢ", "OP"), ("mười l1I0O", "mười l1I0O"), ("điều Ơ ư", "điều Ơ ư"), ("x² ³", "x² ³"), ("日本 한국 مرحبا", "日本 한국 مرحبا")])
def test_public_rules(spark, given, want):
    """Font variants and letters of the confusables data; Latin, Vietnamese and other scripts stay as they are."""
    assert duckdb.execute(f"SELECT {A.form_sql('c', A.confusable_letters(spark))} FROM (SELECT ?::VARCHAR AS c)", [given]).fetchone()[0] == want


def test_pairs(spark, rows):
    """Spellings against spellings, equal values unpaired, blanks and nulls out, repeated rows, an extra column of a clashing name."""
    data = [("1", "Điều 1", "x", 0), ("2", "Điều 1", "x ", 0), ("3", "Điều 1", None, 0), ("3", "Điều 1", None, 0), ("4", "điều 1", "​", 0), ("5", " ", " ", 0), ("6", "", "", 0), (None, "Ｄiều", "y", 0), ("7", None, "х", 0)]
    df = spark.createDataFrame(data, "chunk_id string, raw string, norm string, form int")
    got = rows(A.look_alikes(df, ["raw", "norm"], "chunk_id"))
    assert got == [("norm", "1", "2"), ("norm", "1", "7"), ("norm", "2", "7"), ("raw", "1", "2"), ("raw", "2", "3")]
    assert A.look_alikes(df.limit(0), ["raw", "norm"], "chunk_id").count() == 0


def test_hot_form(spark):
    """A third of all rows hold one article in one spelling, one row another."""
    data = [(f"{i:04d}", "Điều 1" if i % 3 == 0 else f"Điều {i}") for i in range(900)] + [("z", "Điều  1")]
    got = A.look_alikes(spark.createDataFrame(data, "chunk_id string, raw string"), ["raw"], "chunk_id")
    assert got.count() == 301 and {r["chunk_id_b"] for r in got.filter("chunk_id_a != '0001'").collect()} == {"z"}


def test_long_text(spark):
    t = "Ｄiều khoản " * 50_000
    got = A.same_form(spark.createDataFrame([("1", t)], "k string, c string"), ["c"], ["k"]).first()
    assert got["form"] == ("Diều khoản " * 50_000).strip()
