"""Queries on oversized items, look-alike spellings and token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.chunking import MAX_WORDS, OVERLAP, split_oversized
from siltstone.llm.lookalike import look_alikes, same_form
from siltstone.sources.tables import table


def _pieces(spark: SparkSession, d: str, oversized_only: bool) -> DataFrame:
    carry = ["doc_id", "article", "clause", "point"]
    out = None
    for name, key in (("macro_chunks", "chunk_id"), ("legal_units", "unit_id")):
        one = split_oversized(table(spark, d, name), [key], "text", carry, oversized_only=oversized_only).withColumnRenamed(key, "item_id").withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False)


def p2_piece_checks(spark: SparkSession, d: str) -> DataFrame:
    """What all pieces must fulfil, by table: items and words whole, no piece too long, the overlap of every later piece as asked."""
    p = p2_pieces(spark, d).withColumn("digest", F.md5("text"))
    one = p.groupBy("table_name", "item_id", "doc_id", "article", "clause", "point", "piece_no", "start_word", "n_words", "n_repeated").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("table_name").agg(
        F.sum(F.when(F.col("piece_no") == 0, F.col("n")).otherwise(0)).alias("n_items"), F.sum((F.col("n_words") - F.col("n_repeated")) * F.col("n")).alias("n_new_words"),
        F.count_if(F.col("n_words") > MAX_WORDS).alias("n_too_long"), F.count_if((F.col("piece_no") > 0) & (F.col("n_repeated") != OVERLAP)).alias("n_other_overlap"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the operator cut: those with a second piece."""
    return _pieces(spark, d, True).filter("piece_no = 1").select("table_name", "item_id").distinct()


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return same_form(table(spark, d, "macro_chunks"), ["text_raw", "text_norm"], ["chunk_id"]).select("chunk_id", "field", "form").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alikes(table(spark, d, "macro_chunks"), ["text_raw", "text_norm"], "chunk_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_piece_checks": p2_piece_checks, "p6_found": p6_found, "p6_forms": p6_forms}

_WHITE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The common form once more, written for itself: what prints nothing by its Unicode class, full-width forms by their
# distance, and letters of other scripts typed beside their Latin likes.
_NOTHING = r"[\p{Cf}\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"
_OTHER = {
    "АВСЕНІЈКМОРЅТХҮԚԜԌ": "ABCEHIJKMOPSTXYQWG", "асеһіјорѕхуԁԛԝүѵӏ": "acehijopsxydqwyvl",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX", "αορνϲϳ": "aopvcj", "ՕՍՏոսօհ": "OUSnuoh", "ɑɡ": "ag", "ÐƉ": "ĐĐ", "‐‑": "--",
}
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))


def _form(c: str) -> str:
    x = f"regexp_replace({c}, '{_NOTHING}', '', 'g')"
    pairs = {_WIDE: "".join(chr(ord(w) - 0xFEE0) for w in _WIDE), **_OTHER}
    for k, v in pairs.items():
        x = "translate(" + x + ", '" + k + "', '" + v.replace("'", "''") + "')"
    return f"trim(regexp_replace(nfc_normalize({x}), '[{_WHITE}]+', ' ', 'g'))"


_SAME = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field, chunk_id, {c} AS v, {_form(c)} AS form FROM macro_chunks" for c in ("text_raw", "text_norm"))
SQL = {
    "p2_found": f"""
      SELECT DISTINCT 'macro_chunks' AS table_name, chunk_id AS item_id FROM macro_chunks WHERE len(regexp_extract_all(text, '[^{_WHITE}]+')) > 800
      UNION SELECT 'legal_units', unit_id FROM legal_units WHERE len(regexp_extract_all(text, '[^{_WHITE}]+')) > 800""",
    "p2_piece_checks": " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, count(*) AS n_items, sum(len(regexp_extract_all(text, '[^{_WHITE}]+')))::BIGINT AS n_new_words, 0::BIGINT AS n_too_long, 0::BIGINT AS n_other_overlap
          FROM (SELECT DISTINCT {key}, doc_id, article, clause, point, text FROM {name} WHERE text IS NOT NULL)"""
        for name, key in (("macro_chunks", "chunk_id"), ("legal_units", "unit_id"))
    ),
    "p6_found": f"""
      WITH s AS ({_SAME}) SELECT DISTINCT a.field AS field, a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b
      FROM s a JOIN s b ON a.field = b.field AND a.form = b.form AND a.chunk_id < b.chunk_id AND a.v <> b.v WHERE a.form <> ''""",
    "p6_forms": f"WITH s AS ({_SAME}) SELECT DISTINCT chunk_id, field, form FROM s",
}
