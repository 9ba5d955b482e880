"""Near-duplicate texts by BagMinHash signatures, bands and exact verification.

A text is the bag of its runs of ``words`` consecutive words.  For every bag
element a Poisson process with the element's weight as rate throws points into
``m`` registers, each of which keeps its earliest point; two bags share a
register with probability equal to their weighted Jaccard similarity.  Weights
are discretised to whole numbers and split into dyadic blocks (0,1], (1,2],
(2,4] and so on, one process a block, seeded by element and block alike in all
texts.  Inside the block that a weight cuts, a point belongs to the text if its
level, read bit by bit from the point's own hash as a descent through halved
intervals, lies below the weight.  An element stops as soon as its next point
comes later than every register of its text, so a long text costs about one
point an element.

Texts with equal bags form one class first; only classes are banded.  Classes
that share a band and whose sizes allow the threshold are candidates; these are
compared by one bit of every register, which leaves out pairs 4.2 standard
deviations below the agreement expected at the threshold, and the others are
verified on the whole bags.  Bands have as many rows as ``REGISTERS`` registers allow while a pair at
the threshold is missed with a probability of ``MISSED`` at most; pairs above
it are missed less.

Words are runs of letters and digits of the lower-cased text.  Defined results:
null texts, and texts with fewer than ``min_words`` words or no shingle, take no
part; repeated rows count once; a repeated id with several texts is judged by
each of them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrow import slices
from siltstone.llm.components import solve
from siltstone.operators.skew import grid_join, salted_join
from siltstone.storage import cut

MISSED, REGISTERS, BROADCAST_IDS = 0.0015, 512, 200_000
_word = re.compile(r"[^\W_]+")
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def bag(text: str, words: int, min_words: int, known: _WordHashes) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted distinct 40-bit shingle hashes and their counts; None if the text takes no part.

    Two bags of n elements share n**2 / 2**40 elements by chance, under one in a
    million for a thousand words.
    """
    found = _word.findall(text.lower())
    n = len(found) - words + 1
    if n < 1 or len(found) < min_words:
        return None
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    s = h[:n].copy()
    for k in range(1, words):
        s *= _STEP
        s ^= s >> np.uint64(32)
        s += h[k : k + n]
    return np.unique(mix(s) >> np.uint64(24), return_counts=True)


def packed(elements: np.ndarray) -> bytes:
    """Elements as five bytes each."""
    return np.ascontiguousarray(elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def signatures(sizes: np.ndarray, elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash registers, an array (texts, m) of 64-bit values, of bags laid end to end."""
    texts = len(sizes)
    doc = np.repeat(np.arange(texts, dtype=np.int64), sizes)
    seeds, los, caps, docs = [], [], [], []
    j, low = 0, 0
    rows = np.arange(len(elements))
    while len(rows):
        seeds.append(mix(elements[rows] + np.uint64((j * 0xD1342543DE82EF95) & (2**64 - 1))))
        docs.append(doc[rows])
        los.append(np.full(len(rows), low, dtype=np.int64))
        caps.append(weights[rows].astype(np.int64))
        low = 1 << j
        j += 1
        rows = rows[weights[rows] > low]
    seed, doc, lo, cap = (np.concatenate(x) for x in (seeds, docs, los, caps))
    span = np.maximum(lo, 1)
    t = np.zeros(len(seed))
    times = np.full(texts * m, np.inf)
    limit = np.full(texts, np.inf)
    i = 0
    with np.errstate(over="ignore"):
        while len(seed):
            i += 1
            h = mix(seed + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            t = t - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * 2.0**-53) / span
            h = mix(h ^ _STEP)
            near = t <= limit[doc]
            at = doc * m + ((h >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            level = lo + 1 + ((h & np.uint64(0xFFFFFFFF)) * span.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            inside = near & (level <= cap)
            np.minimum.at(times, at[inside], t[inside])
            touched = np.unique(doc[inside])
            limit[touched] = times.reshape(texts, m)[touched].max(axis=1)
            go = t <= limit[doc]
            seed, doc, lo, cap, span, t = seed[go], doc[go], lo[go], cap[go], span[go], t[go]
    return times.view(np.uint64).reshape(texts, m)


def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows for a threshold: a pair at it shares no band with probability ``(1 - t**rows)**bands``."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    for rows in range(8, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(MISSED) / math.log(1 - hit))
        if bands * rows <= REGISTERS or rows == 1:
            return bands, rows


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        r = registers[:, : bands * rows].reshape(len(registers), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(registers), bands)).copy()
        for k in range(rows):
            key = mix(key ^ r[:, :, k])
    return key.view(np.int64)


def _class_key(b: tuple[np.ndarray, np.ndarray], weighted: bool) -> str:
    h = hashlib.md5(b[0].tobytes())
    if weighted:
        h.update(b[1].astype(np.int64).tobytes())
    return h.hexdigest()


def sketch(registers: np.ndarray) -> np.ndarray:
    """One bit of every register, packed into 64-bit integers."""
    with np.errstate(over="ignore"):
        bits = (mix(registers ^ _STEP) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(packed).view(np.int64)


def least_agreement(threshold: float, m: int) -> int:
    """Bits that agree at least, 4.2 standard deviations below those expected at the threshold."""
    p = (1 + threshold) / 2
    return math.floor(m * p - 4.2 * math.sqrt(m * p * (1 - p)))


def signature_table(texts: DataFrame, words: int, min_words: int, weighted: bool, bands: int, rows: int) -> DataFrame:
    """``id, class_key, c, size, keys, bits`` of ``texts(id, text)`` that take part.

    ``c`` is a number made from the class key; two classes with one number are
    only compared once more than needed.  ``keys`` and ``bits`` are null where
    the same class came shortly before in the partition.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHashes(), set()
        for b in slices(batches, "text", 2 << 20):
            ids, classes, sizes, new, bags = [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = bag(text, words, min_words, known)
                if got is None:
                    continue
                got = got if weighted else (got[0], np.ones_like(got[1]))
                ids.append(key)
                classes.append(_class_key(got, weighted))
                sizes.append(int(got[1].sum()))
                if len(seen) > 1 << 17:
                    seen.clear()
                new.append(classes[-1] not in seen)
                if new[-1]:
                    seen.add(classes[-1])
                    bags.append(got)
            if not ids:
                continue
            keys = bits = np.zeros((0, 1), np.int64)
            if bags:
                r = signatures(np.array([len(x[0]) for x in bags]), np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags]), bands * rows)
                keys, bits = band_keys(r, bands, rows), sketch(r)
            c = [int.from_bytes(bytes.fromhex(k)[:8], "little", signed=True) for k in classes]
            place = pa.array(np.where(new, np.cumsum(new) - 1, -1), mask=~np.array(new))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())).take(place) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(classes), pa.array(c, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["id", "class_key", "c", "size", "keys", "bits"])

    schema = "id string, class_key string, c long, size long, keys array<long>, bits array<long>"
    return texts.select("id", "text").filter("text is not null and id is not null").mapInArrow(work, schema)


def similarity(a: bytes, wa: bytes | None, b: bytes, wb: bytes | None, weighted: bool) -> float:
    """Jaccard similarity of two bags, of their distinct elements unless ``weighted``."""
    x, y = unpacked(a), unpacked(b)
    if not weighted or wa is None and wb is None:
        same = len(np.intersect1d(x, y, assume_unique=True))
        return same / (len(x) + len(y) - same)
    wx = np.frombuffer(wa, np.uint32).astype(np.int64) if wa is not None else np.ones(len(x), np.int64)
    wy = np.frombuffer(wb, np.uint32).astype(np.int64) if wb is not None else np.ones(len(y), np.int64)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    same = int(np.minimum(wx[i], wy[j]).sum())
    return same / (int(wx.sum()) + int(wy.sum()) - same)


def verified(pairs: DataFrame, bags: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Class keys ``a < b`` of the pairs whose bags reach the threshold, with ``similarity``."""
    left = bags.select("c", F.col("id").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = bags.select("c", F.col("id").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("ea", "wa", "eb", "wb")}
            s = np.array([similarity(col["ea"][i].as_py(), col["wa"][i].as_py(), col["eb"][i].as_py(), col["wb"][i].as_py(), weighted) for i in range(b.num_rows)], dtype=np.float64)
            ok = np.flatnonzero(s >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("a")).take(pa.array(ok)), b.column(b.schema.get_field_index("b")).take(pa.array(ok)), pa.array(s[ok])], ["a", "b", "similarity"])

    near = pairs.toDF("ca", "cb").join(left.withColumnRenamed("c", "ca"), "ca").join(right.withColumnRenamed("c", "cb"), "cb")
    swap = F.col("a") > F.col("b")
    near = near.select(*[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ea", "eb"), ("wa", "wb"), ("eb", "ea"), ("wb", "wa"))])
    return near.select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(work, "a string, b string, similarity double")


def links(texts: DataFrame, words: int = 5, threshold: float = 0.8, min_words: int = 1, weighted: bool = True, bands_rows: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal bags and the classes' members.

    ``texts(id, text)``.  Returns ``(a, b, similarity)`` with class keys
    ``a < b`` and ``(class_key, id)``.
    """
    bands, rows = bands_rows or banding(threshold)
    texts = texts.select(F.col("id").cast("string").alias("id"), "text")
    sig = cut(signature_table(texts, words, min_words, weighted, bands, rows), "signatures")
    members = sig.select("class_key", "id").distinct()
    first = sig.filter("keys is not null")
    m = bands * rows
    band = first.select(F.explode("keys").alias("key"), F.col("c").alias("a"), F.col("size").alias("na"))
    band = band.repartition("key").dropDuplicates(["key", "a"])
    other = band.select("key", F.col("a").alias("b"), F.col("na").alias("nb"))
    # A band that very many texts share is cut into a grid of tasks; keys alone, from the written signatures, tell which.
    keys = first.select(F.explode("keys").alias("key"))
    sized = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    met = grid_join(band, other, ["key"], (["a"], ["b"]), seen=(keys, keys.limit(0))).filter((F.col("a") < F.col("b")) & sized).select("a", "b").distinct()
    # What shares a band by chance is left out by the sketches, which only candidates meet.
    bits = first.select("c", *[F.get("bits", F.lit(i)).alias(f"x{i}") for i in range(-(-m // 64))]).dropDuplicates(["c"])
    words_of = range(len(bits.columns) - 1)
    sides = [bits.select(F.col("c").alias(k), *[F.col(f"x{i}").alias(f"{k}{i}") for i in words_of]) for k in ("a", "b")]
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in words_of), F.lit(0))
    near = cut(met, "met").join(sides[0], "a").join(sides[1], "b").filter(m - differ >= least_agreement(threshold, m)).select("a", "b")
    pairs = cut(near, "candidates")
    chosen = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    ids = first.join(chosen, "c", "left_semi").groupBy("class_key").agg(F.min("id").alias("id")).select("id").distinct()
    # A repeated id may carry several texts, so bags are named by their own class key.
    ids = cut(ids, "ids")
    # Up to a bound the ids go to every task and the texts stay where they are; beyond it both are shuffled.
    few = F.broadcast if ids.count() <= BROADCAST_IDS else lambda df: df
    bags = bag_classes(texts.join(few(ids), "id", "left_semi").dropDuplicates(["id", "text"]), words, min_words, weighted)
    bags = cut(bags.join(chosen, "c", "left_semi"), "bags")
    return cut(verified(pairs, bags, threshold, weighted).distinct(), "links"), members


def bag_classes(texts: DataFrame, words: int, min_words: int, weighted: bool) -> DataFrame:
    """Bags of texts named by class: ``id`` (the class key), ``c``, ``elements``, ``weights``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in slices(batches, "text", 2 << 20):
            keys, a, w = [], [], []
            for text in b.column(0).to_pylist():
                got = bag(text, words, min_words, known)
                if got is not None:
                    keys.append(_class_key(got if weighted else (got[0], np.ones_like(got[1])), weighted))
                    a.append(packed(got[0]))
                    w.append(got[1].astype(np.uint32).tobytes() if weighted and (got[1] > 1).any() else None)
            c = [int.from_bytes(bytes.fromhex(k)[:8], "little", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(c, pa.int64()), pa.array(a, pa.binary()), pa.array(w, pa.binary())], ["id", "c", "elements", "weights"])

    return texts.select("text").filter("text is not null").mapInArrow(work, "id string, c long, elements binary, weights binary")


def pairs_of(link: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids ``a < b`` that linked classes and equal members stand for."""
    members = cut(members, "members")
    m = members.select(F.col("class_key").alias("b"), F.col("id").alias("ib"))
    linked = link.select("a", "b").union(members.groupBy("class_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class_key", "class_key"))
    own = members.select(F.col("class_key").alias("a"), F.col("id").alias("ia"))
    one = salted_join(own, linked, ["a"], ["ia"], seen=members.select(F.col("class_key").alias("a")))
    seen = members.select(F.col("class_key").alias("b"))
    ids = grid_join(one, m, ["b"], (["ia"], ["ib"]), seen=(seen, seen)).filter("ia != ib")
    return ids.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct()


def groups(texts: DataFrame, words: int = 5, threshold: float = 0.8, min_words: int = 1, weighted: bool = True) -> DataFrame:
    """``id, group_id, n_links`` of every text that takes part.

    ``group_id`` is the smallest id reachable over links and equal bags;
    ``n_links`` counts the linked texts with another bag.
    """
    link, members = links(texts, words, threshold, min_words, weighted)
    members = cut(members, "members")
    both = link.select("a", "b").union(link.select("b", "a"))
    size = members.groupBy("class_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    count = both.join(size.select(F.col("class_key").alias("b"), "n"), "b").groupBy(F.col("a").alias("class_key")).agg(F.sum("n").alias("n_links"))
    roots = solve(link.select("a", "b")).select(F.col("node").alias("class_key"), "root")
    info = size.join(roots, "class_key", "left").join(count, "class_key", "left").select("class_key", "first", F.coalesce("root", "class_key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    info = cut(info, "classes")
    name = info.groupBy("root").agg(F.min("first").alias("group_id"))
    info = salted_join(info, name, ["root"], ["class_key"]).select("class_key", "group_id", "n_links")
    return salted_join(members, info, ["class_key"], ["id"]).select("id", "group_id", "n_links")
