"""Text functions as column expressions: normal forms, legal signals, tokens.

All of them run on the JVM; normal forms use the ICU library that ships with
Spark.  Null input gives the empty string or an empty array unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as a character class that Java and RE2 read alike.
WS = r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Patterns of statutory references; \b and case follow Unicode.
DOC_NUMBER = r"(?iuU)\b\d{1,5}/(?:\d{4}(?:/[A-ZĐa-z\-]+)?|(?:[A-ZĐa-z]+-[A-ZĐa-z]+))\b"
ARTICLE = r"(?iuU)\bđiều\s+(\d+[a-zA-Z]?)\b"
CLAUSE = r"(?iuU)\bkhoản\s+(\d+[a-zA-Z]?)\b"
POINT = r"(?iuU)\bđiểm\s+([a-zA-Z\d]+)\b"
YEAR = r"(?iuU)\bnăm\s+(?:\d{4})\b|\b(?:19\d{2}|20\d{2})\b"
TYPE_WORDS = "Luật|Bộ luật|Nghị định|Thông tư liên tịch|Thông tư|Quyết định|Chỉ thị|Nghị quyết|Tiêu chuẩn|Công văn|Pháp lệnh"
DOC_TYPE = rf"(?iuU)\b({TYPE_WORDS})\b"
NUMBER_AFTER_SO = r"(?iu)(?:Số|Số\s*:)\s*([0-9]+(?:/[0-9]+)?(?:/[A-ZĐ0-9\-_]+)?)"
NUMBER_IN_NAME = r"(\d+[-/][0-9A-Za-zĐ-]+)"
YEAR_IN_TITLE = r"(?U)\b(19[89]\d|20[012]\d)\b"
LOOSE_NUMBER = r"(?iu)(\d+[/\-][0-9]+[/\-][A-ZĐa-z0-9\-_]+|\d+[/\-][A-ZĐa-z0-9\-_]+)"
LEGAL_TOKEN = r"(\d+[/\-][0-9a-zà-ỹ\-_/]+|[a-zà-ỹ0-9]+)"
WORD = r"[\p{L}\p{N}_]+"
#: Document kinds by the slug that file names use.
KINDS = {"nghi-dinh": "Nghị định", "thong-tu": "Thông tư", "quyet-dinh": "Quyết định", "luat": "Luật", "bo-luat": "Bộ luật"}
SUFFIXES = (("ND-CP", "NĐ-CP"), ("QD-TTG", "QĐ-TTg"), ("BLDTBXH", "BLĐTBXH"))
SLUG_NUMBER = r"(?i)(Nghi-dinh|Thong-tu|Quyet-dinh|Luat|Bo-luat)-(\d+)-(\d+)-([A-ZĐa-z]+-[A-ZĐa-z]+|[A-ZĐa-z]+)"
#: Fixed value: spellings that count as absent where text is rendered.
MISSING = ("", "nan", "nat", "none", "null")


def _icu(method: str, c: Column, compat: bool) -> Column:
    return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(compat)))


def nfc(c: Column) -> Column:
    """Canonical composition; null stays null."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_icu("compose", c, False))


def nfkd(c: Column) -> Column:
    """Compatibility decomposition; null stays null."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_icu("decompose", c, True))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean(c: Column) -> Column:
    """NFC, straight quotes, every run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(nfc(text(c)), "“”‘’", "\"\"''"), WS + "+", " "))


def _trim_white(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def block(c: Column) -> Column:
    """NFC, blanks and tabs collapsed, empty lines dropped, line breaks kept, trimmed."""
    return _trim_white(F.regexp_replace(F.regexp_replace(nfc(text(c)), r"[ \t]+", " "), rf"\n{WS}*\n+", "\n"))


def folded(c: Column) -> Column:
    """NFC, blanks and tabs collapsed, trimmed, lower case."""
    return F.lower(_trim_white(F.regexp_replace(nfc(text(c)), r"[ \t]+", " ")))


def question(c: Column) -> Column:
    """``clean`` in lower case with sentence marks as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean(c)), r"[?!.,;:'\"_]+", " "), WS + "+", " "))


def unaccented(c: Column) -> Column:
    """No accents, đ as d, separators as one blank, lower case."""
    bare = F.translate(F.regexp_replace(nfkd(text(c)), r"\p{M}+", ""), "đĐ", "dd")
    return F.lower(_trim_white(F.regexp_replace(bare, r"[ \t\-_/]+", " ")))


def pretty_title(c: Column) -> Column:
    """A display title from a slug: the kind of act and its number where the slug names both."""
    name = F.regexp_replace(_trim_white(text(c)), r"-\d{4,8}$", "")
    kind = F.lower(F.regexp_extract(name, SLUG_NUMBER, 1))
    shown = F.lit(None).cast("string")
    for slug, title in KINDS.items():
        shown = F.when(kind == slug, F.lit(title)).otherwise(shown)
    suffix = F.upper(F.regexp_extract(name, SLUG_NUMBER, 4))
    for plain, spelled in SUFFIXES:
        suffix = F.replace(suffix, F.lit(plain), F.lit(spelled))
    number = F.concat_ws("/", F.regexp_extract(name, SLUG_NUMBER, 2), F.regexp_extract(name, SLUG_NUMBER, 3), suffix)
    titled = F.when(kind != "", F.concat_ws(" ", shown, number)).otherwise(F.replace(name, F.lit("-"), F.lit(" ")))
    return F.when(text(c).isin("", "None", "nan"), F.lit("")).otherwise(titled)


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def doc_numbers(cleaned: Column) -> Column:
    return F.array_distinct(F.transform(_all(cleaned, DOC_NUMBER, 0), F.upper))


def articles(cleaned: Column) -> Column:
    return F.array_distinct(_all(cleaned, ARTICLE, 1))


def clauses(cleaned: Column) -> Column:
    return F.array_distinct(_all(cleaned, CLAUSE, 1))


def points(cleaned: Column) -> Column:
    return F.array_distinct(_all(cleaned, POINT, 1))


def years(cleaned: Column) -> Column:
    return F.array_distinct(F.transform(_all(cleaned, YEAR, 0), lambda y: F.right(y, F.lit(4))))


def doc_types(c: Column) -> Column:
    return F.array_distinct(F.transform(_all(text(c), DOC_TYPE, 1), F.lower))


def signals(c: Column) -> Column:
    """Distinct document numbers, articles, clauses, points and years in order of appearance."""
    x = clean(c)
    return F.struct(doc_numbers(x).alias("doc_numbers"), articles(x).alias("articles"), clauses(x).alias("clauses"), points(x).alias("points"), years(x).alias("years"))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def metadata(doc_id: Column, name: Column, link: Column, passage: Column) -> Column:
    """Title, number, year and kind of an act from its name, link and first 2,000 characters."""
    name, link, start = text(name), text(link), F.left(text(passage), F.lit(2000))

    def unslugged(s: Column) -> Column:
        return F.trim(F.replace(F.regexp_replace(s, r"-\d+$", ""), F.lit("-"), F.lit(" ")))

    title = F.when(name != "", unslugged(name)).when(link != "", unslugged(slug(link))).otherwise(F.concat(F.lit("Văn bản pháp luật "), doc_id.cast("string")))
    number = F.coalesce(_first(start, NUMBER_AFTER_SO), F.replace(_first(name, NUMBER_IN_NAME), F.lit("-"), F.lit("/")))
    year = F.coalesce(_first(start, YEAR_IN_TITLE), _first(name, YEAR_IN_TITLE))
    kind = F.coalesce(_first(start, DOC_TYPE), _first(title, DOC_TYPE), F.lit("Văn bản"))
    return F.struct(title.alias("title"), number.alias("legal_number"), year.alias("year"), F.concat(F.upper(F.left(kind, F.lit(1))), F.lower(F.substr(kind, F.lit(2)))).alias("doc_type"))


def slug(link: Column) -> Column:
    """The last path segment of a link."""
    return F.element_at(F.split(F.regexp_replace(text(link), "/+$", ""), "/"), -1)


def legal_tokens(c: Column) -> Column:
    """Lower-case tokens; statutory identifiers stay whole."""
    return _all(F.lower(nfc(text(c))), LEGAL_TOKEN, 1)


def segmented_tokens(c: Column) -> Column:
    """Word tokens of the cleaned text; without a segmenter each syllable is a token.

    Cleaning changes only quotes and white space, of which no token has any, so it is left out.
    """
    return word_tokens(c)


def word_tokens(c: Column) -> Column:
    return _all(F.lower(nfc(text(c))), WORD, 0)


def token_set(c: Column) -> Column:
    return F.array_distinct(_all(folded(c), r"(?U)\b[a-zà-ỹ0-9_/\-]+\b", 0))


def dense_text(c: Column) -> Column:
    """What an encoder receives: NFC with white space collapsed."""
    return F.trim(F.regexp_replace(nfc(text(c)), WS + "+", " "))


def truncated(c: Column, limit: Column) -> Column:
    """At most ``limit`` characters, cut at the last blank past half of them, with an ellipsis."""
    target = limit - 3
    head = F.substring(c, F.lit(1), target)
    space = target - F.locate(" ", F.reverse(head))  # place of the last blank, from 0
    at_space = (F.locate(" ", head) > 0) & (space > F.floor(target / 2))
    cut = F.when(at_space, F.substring(c, F.lit(1), space)).otherwise(head)
    short = F.when(limit <= 3, F.substring(c, F.lit(1), limit)).otherwise(F.concat(F.regexp_replace(cut, f"{WS}+$", ""), F.lit("...")))
    return F.when(F.length(c) <= limit, c).otherwise(short)


def present(c: Column) -> Column:
    """Whether a value is given where text is rendered."""
    return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin(*MISSING)


def shown(c: Column, default: Column | str = "") -> Column:
    d = F.lit(default) if isinstance(default, str) else default
    return F.when(present(c), F.trim(c.cast("string"))).otherwise(d)


def safe_number(c: Column, default: float = 0.0) -> Column:
    """A finite double, else the default; text that is no number counts as missing."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def sigmoid(x: Column) -> Column:
    """The logistic function, 0 and 1 beyond 50 either way."""
    return F.when(x >= 50, 1.0).when(x <= -50, 0.0).otherwise(1 / (1 + F.exp(-x)))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit_vector(v: Column) -> Column:
    """L2-normalised doubles; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
