"""Structure of legal texts: articles, clauses and points, and chunks of bounded size.

Scanning a text for nested headings depends on what came before, so it runs in
Arrow batches, one text a row; windows over words are plain expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X

#: Line headings for the line scan, and headings with their line for the offset scan.
LINE = {
    "chapter": re.compile(r"(Chương\s+[IVXLCDM\d]+[.:\s-]*[^\n]*)", re.I), "section": re.compile(r"(Mục\s+\d+[.:\s-]*[^\n]*)", re.I),
    "article": re.compile(r"(Điều\s+\d+[a-zA-Z]?[.:\s-]*[^\n]*)", re.I), "clause": re.compile(r"(\d+)\.\s+([^\n]+)"),
}
HEAD = {
    "chapter": re.compile(r"(?:^|\n)\s*(Chương\s+[IVXLCDM\d]+[^\n]*)", re.I), "section": re.compile(r"(?:^|\n)\s*(Mục\s+\d+[^\n]*)", re.I),
    "article": re.compile(r"(?:^|\n)\s*(Điều\s+\d+[.:\s][^\n]*)", re.I), "clause": re.compile(r"(?:^|\n)\s*(\d+)\.\s+[^\n]*"), "point": re.compile(r"(?:^|\n)\s*([a-zđ])\)\s+[^\n]*", re.I),
}
WHOLE = "Toàn văn"
_quotes = str.maketrans("“”‘’", "\"\"''")


def cleaned(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).translate(_quotes).split())


def normal(text: str) -> str:
    t = re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", text or ""))
    return re.sub(r"\n\s*\n+", "\n", t).strip()


def article_rows(text: str | None) -> list[tuple[str, str, str, str, str]]:
    """``chapter, section, article, last clause, text`` of every article, in order of lines.

    A text without articles is one row named as the whole text; a blank one has no rows.
    """
    out, context, body = [], {"chapter": "", "section": "", "article": "", "clause": ""}, []

    def close() -> None:
        if context["article"] and body:
            out.append((context["chapter"], context["section"], context["article"], context["clause"], "\n".join(body).strip()))

    for line in map(str.strip, (text or "").split("\n")):
        kind = next((k for k in ("chapter", "section", "article") if LINE[k].match(line)), None) if line else ""
        if kind == "article":
            close()
            context |= {"article": LINE[kind].match(line)[1], "clause": ""}
            body = [line]
        elif kind:
            context[kind] = LINE[kind].match(line)[1]
        elif line:
            if context["article"] and (m := LINE["clause"].match(line)):
                context["clause"] = f"Khoản {m[1]}"
            body.append(line)
    close()
    if not out and (text or "").strip():
        out.append(("", "", WHOLE, "", text))
    return out


def _spans(pattern: re.Pattern, text: str) -> list[tuple[re.Match, str]]:
    """Matches and the stripped text from each to the next."""
    found = list(pattern.finditer(text))
    ends = [*[m.start() for m in found[1:]], len(text)] if found else []
    return [(m, text[m.start() : e].strip()) for m, e in zip(found, ends, strict=True)]


@dataclass(frozen=True)
class Unit:
    chapter: str | None
    section: str | None
    article: str
    clause: str | None
    point: str | None
    text: str


def units(text: str | None) -> list[Unit]:
    """The deepest level there is of every article: points, else clauses, else the article's body.

    A chapter ends the section before it.  A text without articles has no units.
    """
    text = text or ""
    out, chapter, section, after = [], None, None, 0
    for m, whole in _spans(HEAD["article"], text):
        between = text[after : m.start()]
        if got := HEAD["chapter"].findall(between):
            chapter, section = got[-1].strip(), None
        if got := HEAD["section"].findall(between):
            section = got[-1].strip()
        after = m.end()
        title, _, body = whole.partition("\n")
        title, body = title.strip(), body.strip()
        parts = _spans(HEAD["clause"], body)
        if not parts:
            out.append(Unit(chapter, section, title, None, None, body or title))
        for c, clause in parts:
            label = f"Khoản {c[1]}"
            points = _spans(HEAD["point"], clause)
            out += [Unit(chapter, section, title, label, f"Điểm {p[1]}", t) for p, t in points] or [Unit(chapter, section, title, label, None, clause)]
    return out


@dataclass(frozen=True)
class Budgets:
    """Sizes in words."""

    macro_min: int = 400
    macro_max: int = 800
    micro_min: int = 100
    micro_max: int = 250
    fallback_min: int = 700
    fallback_max: int = 1200
    overlap: int = 150
    micro_overlap: int = 50


def effective(least: int, most: int, header_words: int) -> int:
    """Words left beside a header, never under the minimum."""
    return max(least, most - header_words)


def windows(words: list[str], size: int, overlap: int) -> list[list[str]]:
    """Overlapping windows; the last is the first to reach the end."""
    if len(words) <= size:
        return [words] if words else []
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    return [words[i : i + size] for i in range(0, len(words) - overlap, size - overlap)]


def window_spans(n: Column, size: int, overlap: int) -> Column:
    """The same windows as an expression: an array of ``first`` (from 0) and ``n_words`` for a word count."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    step = size - overlap
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    one = lambda i: F.struct((i * step).cast("int").alias("first"), F.least(n - i * step, F.lit(size)).cast("int").alias("n_words"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one)).otherwise(F.array().cast("array<struct<first:int,n_words:int>>"))


CHUNK = "chunk_id string, doc_id string, granularity string, chapter string, section string, article string, clause string, point string, text_raw string, text_norm string, parent_chunk_id string, token_count int, is_empty boolean"


#: The markers in chunk texts ([VĂN BẢN], [ĐOẠN n], [CĂN CỨ], [ĐIỀU KHOẢN], [NỘI DUNG]), labels and ids of chunks, and 30 words for a preamble.
class _Chunker:
    """Chunks of one document: macros with their micros."""

    def __init__(self, doc_id: str, title: str | None, number: str | None, b: Budgets):
        self.id, self.b, self.rows, self.macros = doc_id, b, [], 0
        self.header = f"[VĂN BẢN]: {title or f'Văn bản pháp luật {doc_id}'}" + (f" (Số: {number})" if number else "")

    def words(self, tail: str) -> int:
        return len(f"{self.header}\n{tail}".split())

    def add(self, raw: str, tail: str, article: str, parent: str | None = None, place: int = 0, clause: str | None = None, unit: Unit | None = None, empty: bool = False) -> str:
        """A macro, or with ``parent`` its micro number ``place``; returns the chunk's id."""
        if parent is None:
            self.macros += 1
        name = f"{self.id}_macro_{self.macros:03d}" if parent is None else f"{self.id}_micro_{self.macros:03d}_{place:02d}"
        shown = normal(f"{self.header}\n{tail}")
        self.rows.append((
            name, self.id, "macro" if parent is None else "micro", unit and unit.chapter, unit and unit.section, unit.article if unit else article, unit.clause if unit else clause,
            unit and unit.point, raw, shown, parent, len(shown.split()), empty,
        ))
        return name

    def micro_windows(self, words: list[str], parent: str, article: str, head: str, clause: str) -> None:
        """Micros over a macro's words; ``head`` and ``clause`` take the number."""
        size = effective(self.b.micro_min, self.b.micro_max, self.words(head.format("99")))
        for i, w in enumerate(windows(words, size, self.b.micro_overlap), 1):
            self.add(" ".join(w), head.format(i) + " ".join(w), article, parent, i, clause.format(i))

    def run(self, passage: str) -> list[tuple]:
        b = self.b
        articles = _spans(HEAD["article"], passage)
        if not articles:
            size = effective(b.fallback_min, b.fallback_max, self.words("[ĐOẠN 99]:\n"))
            for i, w in enumerate(windows(passage.split(), size, b.overlap), 1):
                macro = self.add(" ".join(w), f"[ĐOẠN {i}]:\n" + " ".join(w), f"Đoạn {i}")
                # The header's words are counted with a two-part number, as it will stand.
                self.micro_windows(w, macro, f"Đoạn {i}", f"[ĐOẠN {i}." + "{}]:\n", "Đoạn nhỏ {}")
            return self.rows
        before = passage[: articles[0][0].start()].strip()
        if len(before.split()) >= 30:
            macro = self.add(before, f"[CĂN CỨ]:\n{before}", "Căn cứ ban hành")
            self.add(before, f"[CĂN CỨ]:\n{before}", "Căn cứ ban hành", macro, 1)
        for _, whole in articles:
            title, _, body = whole.partition("\n")
            title, body, words = title.strip(), body.strip(), whole.split()
            size = effective(b.macro_min, b.macro_max, self.words(f"[ĐIỀU KHOẢN]: {title} (Phần 99)\n[NỘI DUNG]:\n"))
            if len(words) > size:
                for i, w in enumerate(windows(words, size, b.overlap), 1):
                    part = f"{title} (Phần {i})"
                    macro = self.add(" ".join(w), f"[ĐIỀU KHOẢN]: {part}\n[NỘI DUNG]:\n" + " ".join(w), part)
                    self.micro_windows(w, macro, title, f"[ĐIỀU KHOẢN]: {title.replace('{', '{{').replace('}', '}}')}\n[ĐOẠN " + "{}]:\n", "Đoạn {}")
                continue
            tail = f"[ĐIỀU KHOẢN]: {title}\n[NỘI DUNG]:\n{body or title}"
            macro = self.add(whole, tail, title)
            parts = units(whole)
            if len(parts) > 1:
                for i, u in enumerate(parts, 1):
                    self.add(u.text, f"[ĐIỀU KHOẢN]: {u.article}\n[{u.clause or f'Khoản {i}'}]:\n{u.text}", u.article, macro, i, unit=u)
            else:
                self.add(whole, tail, title, macro, 1)
        return self.rows


def document_chunks(doc_id: str, title: str | None, number: str | None, passage: str | None, is_empty: bool | None, budgets: Budgets = Budgets()) -> list[tuple]:
    """All chunks of one document as rows of ``CHUNK``; an empty one has a single macro of its metadata."""
    c, text = _Chunker(doc_id, title, number, budgets), normal(passage or "")
    if is_empty or not text:
        c.add("", "[NỘI DUNG]: Văn bản không có nội dung chi tiết.", "Thông tin văn bản", empty=True)
        return c.rows
    return c.run(text)


def _per_row(df: DataFrame, f, schema: str) -> DataFrame:
    """Rows of ``f`` for each row of ``df``; every output column is built from Python values."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cols = [c.to_pylist() for c in b.slice(at, 256).columns]
                rows = [r for values in zip(*cols, strict=True) for r in f(*values)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return df.mapInArrow(work, schema)


def articles(docs: DataFrame) -> DataFrame:
    """Article rows of ``doc_id, text``, numbered from 1."""

    def f(doc_id, text):
        return [(doc_id, i, *r) for i, r in enumerate(article_rows(text), 1)]

    return _per_row(docs.select("doc_id", "text"), f, "doc_id string, n int, chapter string, section string, article string, clause string, text_raw string")


def legal_units(docs: DataFrame) -> DataFrame:
    """Units of ``doc_id, text``, numbered from 1."""

    def f(doc_id, text):
        return [(doc_id, i, u.chapter, u.section, u.article, u.clause, u.point, u.text) for i, u in enumerate(units(text), 1)]

    return _per_row(docs.select("doc_id", "text"), f, "doc_id string, n int, chapter string, section string, article string, clause string, point string, text string")


def chunked(docs: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """Chunks of ``doc_id, title, legal_number, text, is_empty``."""
    return _per_row(docs.select("doc_id", "title", "legal_number", "text", "is_empty"), lambda *r: document_chunks(*r, budgets), CHUNK)


def header_words(title: Column, number: Column) -> Column:
    """Words of the header that stands before every chunk."""
    head = F.concat(F.lit("[VĂN BẢN]: "), title, F.when(X.text(number) != "", F.concat(F.lit(" (Số: "), number, F.lit(")"))).otherwise(""))
    return F.regexp_count(head, F.lit(r"\S+"))
