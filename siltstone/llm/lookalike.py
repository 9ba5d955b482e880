"""One form for texts that look the same but are stored in different characters.

Embedded SQL runs inside every Arrow batch: look-alike letters, full-width and
other compatibility forms are mapped by ``translate`` and ``replace``, what
prints nothing is removed and white space collapsed by regular expressions, and
``nfc_normalize`` brings accents to one encoding, after the mapping, so that
a foreign base letter with a combining accent is composed too.  Letter case,
accents with their placement, and raised digits are kept.

Besides the fixed list, single characters are mapped by two public rules: the
compatibility forms that Unicode calls font, wide and narrow variants, and the
confusables data of the ICU library that Spark brings along, as far as a letter
outside the Latin script has an ASCII letter of its own case as its skeleton.
The map is made once a session on the driver and is part of the SQL; texts
without any character of the long list take a shorter way to the same form.

Defined results: null stays null; a text of white space and invisible
characters only becomes the empty form, which equals no other; repeated rows
count once.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.llm.arrow import slices
from siltstone.operators.skew import grid_join, salted_join
from siltstone.storage import cut

#: Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚK", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аɑα", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ", "p": "рρ", "q": "ԛ", "s": "ѕꜱ",
    "u": "ս", "v": "ѵνᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ", "ı": "ι", "Å": "Å", "Đ": "ÐƉ", "-": "‐‑",
}
#: Characters that print nothing, as ranges of code points.
INVISIBLE = ((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
             (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF))
#: The characters of the Unicode property White_Space.
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _spaced(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in SPACES)


@lru_cache(maxsize=1)
def single_forms() -> dict[str, str]:
    """Characters that become one other character."""
    out = {}
    for cp in range(0xA0, sys.maxunicode + 1):
        tag, _, form = unicodedata.decomposition(chr(cp)).partition(" ")
        plain = unicodedata.normalize("NFKC", chr(cp))
        if tag in ("<font>", "<wide>", "<narrow>") and len(plain) == 1 and not _spaced(plain):
            out[chr(cp)] = plain
    out["\u00b5"] = "\u03bc"
    for cp in [*range(0xFF01, 0xFFEF), *range(0x2160, 0x2180)]:
        c = chr(cp)
        tag, _, form = unicodedata.decomposition(c).partition(" ")
        plain = unicodedata.normalize("NFKC", c)
        if tag in ("<wide>", "<narrow>", "<compat>") and len(plain) == 1 and form and not _spaced(plain):
            out[c] = plain
    for latin, others in LOOK_ALIKES.items():
        out |= dict.fromkeys(others, latin)
    return out


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letters outside the Latin script whose skeleton in the public confusables data is that of an ASCII letter of their case.

    Letters without case take the capital, or the small letter where only that
    looks alike; letters with accents keep them, as they are mapped by their base.
    """
    global _confusable
    if _confusable is None:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        plain = string.ascii_uppercase + string.ascii_lowercase
        by: dict[str, list[str]] = {}
        for c, k in zip(plain, checker.getSkeleton("\n".join(plain)).split("\n"), strict=True):
            by.setdefault(k, []).append(c)
        letters = [chr(cp) for cp in range(0x80, 0x20000) if unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lo", "Lt") and not unicodedata.name(chr(cp), "LATIN").startswith(("LATIN", "CJK", "HANGUL", "ARABIC")) and len(unicodedata.normalize("NFD", chr(cp))) == 1]
        _confusable = {}
        for c, k in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
            kind = unicodedata.category(c)
            fit = [x for x in by.get(k, []) if kind == "Lo" or x.isupper() == (kind == "Lu")]
            if fit:
                _confusable[c] = fit[0]
    return _confusable


_confusable: dict[str, str] | None = None


def multiple_forms() -> dict[str, str]:
    """Characters that become several: precomposed foreign letters, ligatures, Roman numerals."""
    singles, out = single_forms(), {}
    for cp in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        full = unicodedata.normalize("NFD", chr(cp))
        if len(full) > 1 and full[0] in singles and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            out[chr(cp)] = unicodedata.normalize("NFC", singles[full[0]] + full[1:])
    for cp in [*range(0x2160, 0x2180), *range(0xFB00, 0xFB07)]:
        plain = unicodedata.normalize("NFKC", chr(cp))
        if len(plain) > 1:
            out[chr(cp)] = plain
    return out


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ranges(ranges) -> str:
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def form_sql(column: str, more: dict[str, str] | None = None) -> str:
    """The SQL expression of the common form of a text column; ``more`` holds further single characters."""
    common = {c: v for c, v in single_forms().items() if ord(c) < 0x10000 and c in _common()}
    every = (more or {}) | single_forms()
    several = multiple_forms()
    spaces = _ranges(SPACES)
    e = f"regexp_replace({column}, '[{_ranges(INVISIBLE)}]+', '', 'g')"

    def translated(x: str, forms: dict[str, str]) -> str:
        return f"translate({x}, {_quoted(''.join(forms))}, {_quoted(''.join(forms.values()))})"

    many = e
    for k, v in several.items():
        many = f"replace({many}, {_quoted(k)}, {_quoted(v)})"
    rare = "[" + "".join([*several, *[c for c in every if c not in common]]) + "]"
    mapped = f"CASE WHEN regexp_matches({column}, '{rare}') THEN {translated(many, every)} WHEN regexp_matches({column}, '[{''.join(re.escape(c) for c in common)}]') THEN {translated(e, common)} ELSE {e} END"
    return f"trim(regexp_replace(nfc_normalize({mapped}), '[{spaces}]+', ' ', 'g'))"


@lru_cache(maxsize=1)
def _common() -> frozenset[str]:
    """Characters of the fixed list and the plain full-width forms."""
    return frozenset("".join(LOOK_ALIKES.values())) | frozenset(map(chr, range(0xFF01, 0xFF5F)))


def same_form(df: DataFrame, columns: list[str], key: list[str], digest: bool = False) -> DataFrame:
    """``key, field, value, form``; with ``digest`` value and form as md5 (form null where blank)."""
    names = [f"k{i}" for i in range(len(key))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = rows.select(*names).schema.add("field", "string").add("value", "string").add("form", "string")
    parts, more = [], confusable_letters(df.sparkSession)
    for i, c in enumerate(columns):
        value, form = (f"md5(c{i})", "CASE WHEN f <> '' THEN md5(f) END") if digest else (f"c{i}", "f")
        parts.append(f"SELECT {', '.join(names)}, '{c}' AS field, {value} AS value, {form} AS form FROM (SELECT *, {form_sql(f'c{i}', more)} AS f FROM batch)")
    sql = " UNION ALL ".join(parts)
    small = [f"c{i}" for i in range(len(columns))]

    out = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
        for b in slices(batches, small, 8 << 20):
            con.register("batch", pa.Table.from_batches([b]))
            t = con.sql(sql).to_arrow_table().cast(out)
            con.unregister("batch")
            yield from t.to_batches()

    return rows.mapInArrow(work, schema).toDF(*key, "field", "value", "form")


def look_alikes(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``field, {key}_a, {key}_b``: pairs of keys whose values differ as strings and look the same.

    Only values of forms with several spellings are paired, spelling against
    spelling, so repeated equal values meet only where a different one exists.
    """
    f = same_form(df, columns, [key], digest=True).filter("form is not null").withColumnRenamed(key, "k").filter("k is not null")
    f = f.select("field", "form", "value", F.col("k").cast("string").alias("k"))
    f = cut(f.distinct(), "forms")
    several = f.groupBy("field", "form").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).filter("lo < hi").select("field", "form")
    rows = cut(salted_join(f, several, ["field", "form"], ["k", "value"]), "spelled")
    spellings = cut(rows.select("field", "form", "value").distinct(), "spellings")
    other = spellings.select("field", "form", F.col("value").alias("value_b"))
    pairs = grid_join(spellings, other, ["field", "form"], (["value"], ["value_b"])).filter("value != value_b")
    a = salted_join(rows, pairs, ["field", "form", "value"], ["k"]).select("field", "form", F.col("k").alias("a"), F.col("value_b").alias("value"))
    # One spelling may stand in many rows on both sides.
    out = grid_join(a, rows, ["field", "form", "value"], (["a"], ["k"]), seen=(rows, rows)).filter("a < k")
    return out.select("field", F.col("a").alias(f"{key}_a"), F.col("k").alias(f"{key}_b")).distinct()
