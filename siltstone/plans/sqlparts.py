"""SQL fragments that mirror column functions in the other engine.

``{B0}`` and ``{B1}`` stand for word boundaries, which RE2 knows for ASCII only.
"""

from __future__ import annotations

from siltstone.functions.text import KINDS, SLUG_NUMBER, SUFFIXES, TYPE_WORDS, WS

B0, B1 = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nfc(x: str) -> str:
    return f"nfc_normalize(coalesce(CAST({x} AS VARCHAR), ''))"


def rep(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def distinct(x: str) -> str:
    """A list's distinct elements in order of appearance."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def clean(x: str) -> str:
    return f"trim({rep(f"translate({nfc(x)}, '“”‘’', {q(chr(34) * 2 + chr(39) * 2)})", WS + '+', ' ')})"


def trim_white(x: str) -> str:
    return rep(x, f"^{WS}+|{WS}+$", "")


def block(x: str) -> str:
    return trim_white(rep(rep(nfc(x), r"[ \t]+", " "), rf"\n{WS}*\n+", "\n").replace("'\n'", "chr(10)"))


def folded(x: str) -> str:
    return f"lower({trim_white(rep(nfc(x), r'[ \t]+', ' '))})"


def question(x: str) -> str:
    marks = r"[?!.,;:'\"_]+"
    return f"trim({rep(rep(f'lower({clean(x)})', marks, ' '), WS + '+', ' ')})"


def unaccented(x: str) -> str:
    bare = f"translate(strip_accents({nfc(x)}), 'đĐ', 'dd')"
    return f"lower({trim_white(rep(bare, r'[ \t\-_/]+', ' '))})"


def pretty_title(x: str) -> str:
    name = f"regexp_replace({trim_white(f"coalesce({x}, '')")}, '-\\d{{4,8}}$', '')"
    kind = f"lower(regexp_extract({name}, {q(SLUG_NUMBER)}, 1))"
    shown = "CASE " + " ".join(f"WHEN {kind} = {q(k)} THEN {q(v)}" for k, v in KINDS.items()) + " END"
    suffix = f"upper(regexp_extract({name}, {q(SLUG_NUMBER)}, 4))"
    for a, b in SUFFIXES:
        suffix = f"replace({suffix}, {q(a)}, {q(b)})"
    number = f"concat_ws('/', regexp_extract({name}, {q(SLUG_NUMBER)}, 2), regexp_extract({name}, {q(SLUG_NUMBER)}, 3), {suffix})"
    return f"CASE WHEN coalesce({x}, '') IN ('', 'None', 'nan') THEN '' WHEN {kind} <> '' THEN concat_ws(' ', {shown}, {number}) ELSE replace({name}, '-', ' ') END"


def doc_numbers(cleaned: str) -> str:
    p = rf"(?i){B0}(\p{{Nd}}{{1,5}}/(?:\p{{Nd}}{{4}}(?:/[A-ZĐa-z\-]*[A-ZĐa-z])?|(?:[A-ZĐa-z]+-[A-ZĐa-z]+)))"
    return distinct(f"list_transform({found(cleaned, p, 1)}, lambda e: upper(e))")


def _after(cleaned: str, word: str, value: str) -> str:
    # Blanks are doubled, as a match takes the character on either side.
    return distinct(found(rep(cleaned, " ", "  "), rf"(?i){B0}{word}{WS}+({value}){B1}", 1))


def articles(cleaned: str) -> str:
    return _after(cleaned, "điều", r"\p{Nd}+[a-zA-Z]?")


def clauses(cleaned: str) -> str:
    return _after(cleaned, "khoản", r"\p{Nd}+[a-zA-Z]?")


def points(cleaned: str) -> str:
    return _after(cleaned, "điểm", r"[a-zA-Z\p{Nd}]+")


def years(cleaned: str) -> str:
    p = rf"(?i){B0}(năm{WS}+\p{{Nd}}{{4}}|19\p{{Nd}}{{2}}|20\p{{Nd}}{{2}}){B1}"
    return distinct(f"list_transform({found(rep(cleaned, ' ', '  '), p, 1)}, lambda e: right(e, 4))")


def doc_types(x: str) -> str:
    # A blank is doubled first, as a match takes the character on either side.
    return distinct(f"list_transform({found(rep(f"coalesce({x}, '')", ' ', '  '), rf'(?i){B0}({TYPE_WORDS.replace(" ", "  ")}){B1}', 1)}, lambda e: replace(lower(e), '  ', ' '))")


def slug(x: str) -> str:
    return f"list_last(string_split(regexp_replace(coalesce({x}, ''), '/+$', ''), '/'))"


def legal_tokens(x: str) -> str:
    return found(f"lower({nfc(x)})", r"(\d+[/\-][0-9a-zà-ỹ\-_/]+|[a-zà-ỹ0-9]+)", 1)


def word_tokens(x: str) -> str:
    return found(f"lower({nfc(x)})", r"[\p{L}\p{N}_]+")


def id_number(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, '(\\d+)$', 1) AS BIGINT)"


#: Canonical tables: one row an id, the last delivery; ties by the whole row.
LAST = {
    "docs": "SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, title, name_raw, link, legal_number, year, doc_type) AS rn_ FROM legal_docs) WHERE rn_ = 1",
    "cks": "SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC, document_id, article, clause, point, token_count) AS rn_ FROM chunks) WHERE rn_ = 1",
    "qs": "SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY loaded_at DESC, gold_count, question_raw) AS rn_ FROM queries_train) WHERE rn_ = 1",
}


def given(c: str) -> str:
    """``reference_id`` of an id column."""
    t = rf"regexp_replace(CAST({c} AS VARCHAR), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
    return f"CASE WHEN lower({t}) NOT IN ('', 'nan', 'none', 'null') THEN {t} END"


LAST["rels"] = f"SELECT DISTINCT q AS query_id, d AS doc_id FROM (SELECT {given('query_id')} AS q, {given('document_id')} AS d FROM qrels WHERE relevance = 1) WHERE q IS NOT NULL AND d IS NOT NULL"


def with_tables(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({LAST[n]})" for n in names)
