"""Evaluation texts inside training texts, by suffix arrays over training shards.

Every Arrow slice of the corpus is a shard.  Its words become 64-bit hashes, and
its suffix array orders all suffixes that are long enough by their first
``least`` words.  Every suffix of every test text is looked up in it by binary
search.  Among the shard's suffixes found, those whose word before is the test
suffix's word before too are tails of longer matches and are left out by a
second search, so a passage is met once where it begins and not once a word.
The longest verbatim run from there follows from prefix sums of the hashes by
halving, and each (document, item) keeps its longest run with the places in
both.  Shards are independent, so a lost one is read again; nothing of the
corpus is shuffled but the hits.

The test side is split into words once and written to the shared folder in
blocks of about ``BLOCK_BYTES`` of text, a folder a block.  A task reads the
corpus once, builds the array of a shard once and probes it with block after
block, of which it holds one at a time; no bound on the size of the test side
is assumed and none of it is broadcast.

Words are runs of letters and digits of the NFC form of the text in lower case
after characters that print nothing are removed.  Defined results: null and
empty texts hold nothing; items shorter than ``least`` words cannot be held;
repeated rows and items count once; a null id is reported as null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrow import slices
from siltstone.llm.lookalike import INVISIBLE
from siltstone.storage import new_path

LEAST, BLOCK_BYTES, SHARD_BYTES, PAIRS = 12, 16 << 20, 8 << 20, 1 << 21
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(40)
_word = re.compile(r"[^\W_]+")
_invisible = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in INVISIBLE) + "]+")


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = _invisible.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    elif not text.isprintable():
        text = _invisible.sub("", text)
    return _word.findall(text.lower())


class _Numbers(dict):
    """64-bit hashes of words, never 0, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
        return h


def numbers(text: str, known: _Numbers) -> np.ndarray:
    found = words_of(text)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


class Sums:
    """Texts of word hashes laid end to end, 0 after each, with prefix sums that compare any two runs at once."""

    def __init__(self, texts: list[np.ndarray], least: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.words = np.zeros(int((sizes + 1).sum()), np.uint64)
        if len(texts):
            self.words[np.repeat(self.starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate(texts)
        n = len(self.words)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE, np.uint64)
            back = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            power[:1] = back[:1] = 1
            self.power, self.back = np.cumprod(power), np.cumprod(back)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * self.power[:n])])
        # Suffixes of at least `least` words, their text, the hash of their first words and the word before, 0 at a text's start.
        room = np.maximum(0, sizes - least + 1)
        self.text = np.repeat(np.arange(len(texts)), room)
        self.at = np.repeat(self.starts, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        self.keys = self.run(self.at, least)
        self.before = np.where(self.at > 0, self.words[np.maximum(self.at - 1, 0)], np.uint64(0))

    def run(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of runs of words, alike for equal runs wherever they stand."""
        with np.errstate(over="ignore"):
            return (self.sums[at + length] - self.sums[at]) * self.back[at]


class Shard(Sums):
    """The suffix array of a shard."""

    def __init__(self, docs: list[np.ndarray], least: int):
        super().__init__(docs, least)
        self.least = least
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted = self.keys[self.order]

    def matches(self, ids: np.ndarray, tests: Sums) -> pd.DataFrame:
        """``doc`` (index), ``item_id``, ``n_words``, ``doc_word``, ``item_word``: the longest run of each pair."""
        parts = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "item_id", "n_words", "doc_word", "item_word")})]
        distinct, which = np.unique(tests.keys, return_inverse=True)
        lo, hi = np.searchsorted(self.sorted, distinct, "left"), np.searchsorted(self.sorted, distinct, "right")
        held = np.flatnonzero(hi > lo)
        if len(held):
            rank = np.full(len(distinct), -1, np.int64)
            rank[held] = np.arange(len(held))
            n = (hi - lo)[held]
            x = self.order[np.repeat(lo[held] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            # Found suffixes by their first words and the word before, which must tell all but one of 2 ** 40 apart.
            place = (np.repeat(np.arange(len(held)), n).astype(np.uint64) << _TOP) | (self.before[x] >> np.uint64(24))
            by = np.argsort(place, kind="stable")
            x, place = x[by], place[by]
            i = np.flatnonzero(rank[which] >= 0)
            r = rank[which[i]].astype(np.uint64)
            own = (r << _TOP) | (tests.before[i] >> np.uint64(24))
            a, d = np.searchsorted(place, r << _TOP), np.searchsorted(place, (r + np.uint64(1)) << _TOP)
            first = tests.before[i] == 0
            b, c = np.where(first, a, np.searchsorted(place, own, "left")), np.where(first, a, np.searchsorted(place, own, "right"))
            # Both stretches of places beside those with the same word before.
            i, begin, size = np.concatenate([i, i]), np.concatenate([a, c]), np.concatenate([b - a, d - c])
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1):
                parts.append(self._longest(ids, tests, i[part], begin[part], size[part], x))
        out = pd.concat(parts)
        return out.sort_values(["doc", "item_id", "n_words", "doc_word", "item_word"], ascending=[True, True, False, True, True]).drop_duplicates(["doc", "item_id"])

    def _longest(self, ids, tests, i, begin, size, found) -> pd.DataFrame:
        i = np.repeat(i, size)
        s = found[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        x, y, doc, item = self.at[s], tests.at[i], self.text[s], tests.text[i]
        low, high = np.full(len(x), self.least), np.minimum(self.ends[doc] - x, tests.ends[item] - y)
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.run(x, half) == tests.run(y, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        out = pd.DataFrame({"doc": doc, "item_id": ids[item], "n_words": low, "doc_word": x - self.starts[doc], "item_word": y - tests.starts[item]})
        return out.sort_values(["doc", "item_id", "n_words", "doc_word", "item_word"], ascending=[True, True, False, True, True]).drop_duplicates(["doc", "item_id"])


_blocks: dict[tuple[str, int, int], tuple[np.ndarray, Sums]] = {}


def _block(path: str, block: int, least: int) -> tuple[np.ndarray, Sums]:
    """One block of the test side; a worker keeps the last one read."""
    name = (path, block, least)
    if name not in _blocks:
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(f"{path}/block={block}")
        t = ds.dataset(inner, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table(columns=["item_id", "words"]).sort_by([("item_id", "ascending"), ("words", "ascending")])
        _blocks.clear()
        _blocks[name] = t.column("item_id").to_numpy(), Sums([np.frombuffer(w, np.uint64) for w in t.column("words").to_pylist()], least)
    return _blocks[name]


def test_side(items: DataFrame, item_key: str, item_text: str, block_bytes: int = BLOCK_BYTES) -> tuple[str, list[int]]:
    """Write the words of all test texts by block; returns the folder and the blocks that hold any."""
    tests = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null and item_id is not null").distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers()
        for b in slices(batches, "text"):
            words = [numbers(t, known).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(words, pa.binary())], ["item_id", "block", "words"])

    path = new_path(items.sparkSession, "items")
    rows = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))
    rows.mapInArrow(work, "item_id long, block int, words binary").repartition("block").write.partitionBy("block").parquet(path)
    blocks = items.sparkSession.read.schema("item_id long, words binary, block int").parquet(path).select("block").distinct().orderBy("block").collect()  # one number a block
    return path, [r[0] for r in blocks]


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_key, item_id, n_words, doc_word, item_word`` of every document that holds ``least`` words of an item in a row."""
    path, blocks = test_side(items, item_key, item_text, block_bytes)
    schema = corpus.select(F.col(key).alias("doc_key")).schema
    for c in ("item_id", "n_words", "doc_word", "item_word"):
        schema = schema.add(c, "long")
    rows = corpus.select(F.col(key).alias("doc_key"), F.col(text).alias("text")).filter("text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Numbers()
        for b in slices(batches, "text", shard_bytes):
            shard = Shard([numbers(x, known) for x in b.column(b.schema.get_field_index("text")).to_pylist()], least)
            for k in blocks:
                hit = shard.matches(*_block(path, k, least))
                if len(hit):
                    cols = [b.column(b.schema.get_field_index("doc_key")).take(pa.array(hit["doc"].to_numpy()))]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(hit[c].to_numpy().astype(np.int64)) for c in ("item_id", "n_words", "doc_word", "item_word")], ["doc_key", "item_id", "n_words", "doc_word", "item_word"])

    return rows.mapInArrow(work, schema)


def without_leaks(corpus: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The documents of ``corpus`` that hold no test item; one with a null id is kept."""
    return corpus.join(found.select(F.col("doc_key").alias(key)).distinct(), key, "left_anti")
