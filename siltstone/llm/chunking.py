r"""Cutting oversized texts into overlapping pieces at content-defined places.

A rolling hash over the last words marks landmarks.  A piece ends at the first
landmark past its minimum size, moved to the nearest natural boundary between
minimum and maximum size: the start of a point or clause, a line end, or a
sentence end, in this order of rank within the nearest distance.  Landmarks
depend on nearby words only, so an edit moves the cuts next to it and the old
cuts return after it.  Every piece after the first repeats the last words of
the piece before.  Texts within the limit pass through on the JVM side.

A word is an unbroken run of characters other than Unicode white space.

Defined results: a null text gives no piece, an empty or blank one gives one
piece of no words; a text without any boundary is cut at a landmark or at the
limit; rows delivered twice count once; a single word is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrow import slices

#: The characters of the Unicode property White_Space.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = f"[^{WHITE}]+"
#: Characters that end a line.
LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
MAX_WORDS, OVERLAP, MIN_NEW, LANDMARK_EVERY, WINDOW = 800, 150, 350, 64, 8

_word = re.compile(WORD)
_unit = re.compile(r"(?:\d{1,3}[.)]|[^\W\d_][.)]|Điều\s+\d+|Khoản\s+\d+|Điểm\s+\w\b|[-–•])(?=\s)")
_ends = tuple(".;:?!…")
_closers = "\"'”’»)]"


def boundaries(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """Rank of the boundary after every word: 3 before a clause or point, 2 line, 1 sentence, 0 none."""
    out = np.zeros(len(starts), dtype=np.int8)
    for i in range(len(starts) - 1):
        gap = text[ends[i] : starts[i + 1]]
        if any(c in gap for c in LINE_ENDS):
            out[i] = 3 if _unit.match(text, starts[i + 1]) else 2
        elif text[starts[i] : ends[i]].rstrip(_closers).endswith(_ends):
            out[i] = 1
    if len(out):
        out[-1] = 3
    return out


def landmarks(words: list[str], every: int = LANDMARK_EVERY, window: int = WINDOW) -> np.ndarray:
    """Indices of words at which the hash of the last ``window`` words is 0 modulo ``every``."""
    import zlib

    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))
    rolled = np.zeros(len(words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            part = h[: len(h) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
            rolled[k:] += part
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
    return np.flatnonzero(rolled % np.uint64(every) == 0)


def cuts(rank: np.ndarray, marks: np.ndarray, n: int, max_words: int, overlap: int, min_new: int) -> list[int]:
    """Ends (exclusive) of the new words of every piece."""
    out, at = [], 0
    while n - at > max_words - (overlap if out else 0):
        limit = at + max_words - (overlap if out else 0)
        low = at + min(min_new, limit - at)
        i = int(np.searchsorted(marks, low - 1))
        mark = int(marks[i]) + 1 if i < len(marks) and marks[i] + 1 <= limit else None
        near = np.flatnonzero(rank[low - 1 : limit]) + low  # possible ends
        if len(near):
            goal = mark if mark is not None else limit
            # Nearest wins; among boundaries within one landmark distance the higher rank does.
            reach = np.abs(near - goal) <= LANDMARK_EVERY // 2
            pool = near[reach] if reach.any() else near
            best = rank[pool - 1].max() if reach.any() else 0
            pool = pool[rank[pool - 1] >= best]
            end = int(pool[np.argmin(np.abs(pool - goal))])
        else:
            end = mark or limit
        out.append(end)
        at = end
    out.append(n)
    return out


def pieces(text: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP, min_new: int = MIN_NEW) -> list[tuple[int, int, int, str]]:
    """``start word, words, repeated words, text`` of every piece of a text."""
    if not 0 <= overlap < max_words:
        raise ValueError("the overlap must be smaller than the piece")
    spans = [m.span() for m in _word.finditer(text)]
    n = len(spans)
    if n <= max_words:
        return [(0, n, 0, text)]
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    rank = boundaries(text, starts, ends)
    marks = landmarks([text[s:e] for s, e in spans])
    out, new = [], 0
    for end in cuts(rank, marks, n, max_words, overlap, min_new):
        back = max(0, new - overlap) if out else 0
        if out:
            back = max(back, out[-1][0])
        out.append((back, end - back, new - back, text[starts[back] : ends[end - 1]]))
        new = end
    return out


def split_oversized(df: DataFrame, key: list[str], text: str, carry: list[str] = (), max_words: int = MAX_WORDS, overlap: int = OVERLAP, min_new: int = MIN_NEW, oversized_only: bool = False) -> DataFrame:
    """Pieces of every text: ``key, carry, piece_no, start_word, n_words, n_repeated, text``."""
    if not 0 <= overlap < max_words:
        raise ValueError("the overlap must be smaller than the piece")
    names = [*key, *carry]
    rows = df.select(*names, F.col(text).alias("text")).filter(F.col("text").isNotNull()).withColumn("n_words", F.regexp_count("text", F.lit(WORD)))
    if not oversized_only:
        # As an aggregate the count is made once a row, before the shuffle that long and short texts share.
        rows = rows.groupBy(*names, "text").agg(F.first("n_words").alias("n_words"))
    schema = df.select(*names).schema
    for f, t in (("piece_no", "integer"), ("start_word", "integer"), ("n_words", "integer"), ("n_repeated", "integer"), ("text", "string")):
        schema = schema.add(f, t)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            index, got = [], []
            for i, t in enumerate(b.column(b.schema.get_field_index("text")).to_pylist()):
                for no, p in enumerate(pieces(t, max_words, overlap, min_new)):
                    index.append(i)
                    got.append((no, *p))
            taken = b.take(pa.array(index, pa.int32()))
            cols = [taken.column(taken.schema.get_field_index(c)) for c in names]
            cols += [pa.array([g[k] for g in got], pa.int32() if k < 4 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "piece_no", "start_word", "n_words", "n_repeated", "text"])

    big = rows.filter(F.col("n_words") > max_words).drop("n_words")
    cut = (big.distinct() if oversized_only else big).mapInArrow(work, schema)
    if oversized_only:
        return cut
    whole = rows.filter(F.col("n_words") <= max_words).select(*names, F.lit(0).alias("piece_no"), F.lit(0).alias("start_word"), "n_words", F.lit(0).alias("n_repeated"), "text")
    return whole.unionByName(cut)
