"""Token ids of whole corpora by a public byte-level vocabulary.

Texts are split into words by the vocabulary's public pattern on the JVM side.
A word is encoded by a fold over its byte array, which merges, step by step, the
leftmost of the adjacent pairs of lowest rank that a rank map, one value of the plan,
names.  The ``FREQUENT`` most frequent distinct words, a fixed bound, are encoded
once and become a second value; every other word is folded where it stands, as
these are few by definition.  So one pass over the texts makes the ids: no word,
text or id is shuffled, joined or broadcast, at any size.  Both values are scalar
subqueries over written tables of one row.  As literals they stood, spelled out,
in every plan, and the driver keeps and logs the texts of plans, 40 MB a run.
Words over ``LONG`` bytes, where the fold's quadratic cost would show, are merged
by a heap in Arrow batches with the same result; texts that may hold one are told
apart by a pattern.  Decoding concatenates the tokens' binary pieces.

The tokenizer file is a parameter and is read on the driver; its size is fixed.

Defined results: null and empty texts give an empty list; white space alone is
encoded as it stands; strings of special tokens are ordinary text; the row
count is kept, repeated rows and null ids included.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from siltstone.storage import cut

FOLDER = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
FREQUENT, FREQUENT_BYTES, LONG = 32768, 64, 256
BUCKETS = 1 << 14
#: A run that may make a word of more than ``LONG`` bytes, of at most four bytes a character.
LONG_RUN = rf"(?U)\p{{L}}{{{LONG // 4},}}|\p{{N}}{{{LONG // 4},}}|[^\s\p{{L}}\p{{N}}]{{{LONG // 4},}}|\s{{{LONG // 4},}}"
#: Fixed value: the public pattern of the byte-level vocabularies; (?U) gives \\s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[bytes], dict[int, int]]:
    """Token bytes by id, and the merged id of every mergeable pair ``left << 16 | right``."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ids.values()) + 1)
    for t, i in ids.items():
        tokens[i] = t
    pairs = {}
    for t, i in sorted(ids.items(), key=lambda x: x[1]):
        if len(t) > 1:
            # The token's own parts: what its bytes merge to by lower ranks alone.
            parts = _merge([t[k : k + 1] for k in range(len(t))], ids, i)
            if len(parts) == 2:
                pairs[ids[parts[0]] << 16 | ids[parts[1]]] = i
    return tokens, pairs


def _merge(parts: list[bytes], ids: dict[bytes, int], below: int) -> list[bytes]:
    while len(parts) > 1:
        rank, at = min((ids.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _bucket(pair: int) -> int:
    return (pair * 40503 >> 8) & (BUCKETS - 1)


def _ranks(pairs: dict[int, int]) -> list[dict[int, int]]:
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in pairs.items():
        buckets[_bucket(k)][k] = v
    return buckets


def rank_map(pairs: dict[int, int]) -> Column:
    """A literal: an array of small maps from pair to merged id."""
    return F.from_json(F.lit(json.dumps(_ranks(pairs), separators=(",", ":"))), "array<map<string,int>>").cast("array<map<bigint,int>>")


def _value(spark: SparkSession, value: list, kind: str, name: str) -> Column:
    """``value`` as a scalar subquery: the plan's text names the table, not what is in it."""
    return cut(spark.createDataFrame([(value,)], f"value {kind}", verifySchema=False).coalesce(1), name).scalar()


def _rank_value(spark: SparkSession, path: str) -> Column:
    return _value(spark, _ranks(vocabulary(path)[1]), "array<map<bigint,int>>", "ranks")


def _with_ids(df: DataFrame, value: Column, ids: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """``keep`` and ``ids`` of ``value``, empty for null.

    Spark refuses a subquery written inside a lambda.  So it is a column first, read
    once, which the optimizer puts in its place: no row ever holds it.
    """
    found = F.transform(F.array("_value"), ids)[0]
    return df.select("*", value.alias("_value")).select(*keep, F.coalesce(found, F.array().cast("array<int>")).alias("ids"))


def _rank(ranks: Column, a: Column, b: Column) -> Column:
    pair = F.shiftleft(a.cast("bigint"), 16).bitwiseOR(b.cast("bigint"))
    return F.get(ranks, F.shiftright(pair * 40503, 8).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))[pair]


def fold_merges(word: Column, byte_ids: Column, ranks: Column) -> Column:
    """Ids of one word: a fold of ranked merges over its bytes."""
    h = F.hex(F.encode(word, "UTF-8"))
    n = F.octet_length(word)
    first = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(byte_ids, F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    def between(ids: Column) -> Column:
        # One rank a pair; the highest int stands for none, so that places stay aligned.
        return F.transform(F.slice(ids, F.lit(1), F.size(ids) - 1), lambda x, i: F.coalesce(_rank(ranks, x, F.get(ids, i + 1)), F.lit(2**31 - 1)))

    start = F.transform(F.array(first), lambda ids: F.struct(ids.alias("ids"), between(ids).alias("near")))[0]

    def step(s: Column, _: Column) -> Column:
        best = F.array_min(s["near"])

        def merged(at: Column) -> Column:
            ids = F.concat(F.slice(s["ids"], F.lit(1), at - 1), F.array(best), F.slice(s["ids"], at + 2, F.size(s["ids"])))
            left = F.when(at > 1, F.array(F.coalesce(_rank(ranks, F.get(s["ids"], at - 2), best), F.lit(2**31 - 1)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 1 < F.size(s["ids"]), F.array(F.coalesce(_rank(ranks, best, F.get(s["ids"], at + 1)), F.lit(2**31 - 1)))).otherwise(F.array().cast("array<int>"))
            near = F.concat(F.slice(s["near"], F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(s["near"], at + 2, F.size(s["near"])))
            return F.struct(ids.alias("ids"), near.alias("near"))

        place = F.array_position(s["near"], best).cast("int")
        return F.when((F.size(s["near"]) > 0) & (best < 2**31 - 1), F.transform(F.array(place), merged)[0]).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda s: s["ids"])


def heap_merges(word: bytes, byte_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges by a heap over linked neighbours, for long words."""
    ids = [byte_ids[x] for x in word]
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 16 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (q := pairs.get(ids[k] << 16 | ids[after[k]])) is not None:
                heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
    return [x for x, live in zip(ids, alive, strict=True) if live]


def _byte_ids(tokens: list[bytes]) -> list[int]:
    at = {t: i for i, t in enumerate(tokens) if len(t) == 1}
    return [at[bytes([x])] for x in range(256)]


def folded(word: Column, path: str, ranks: Column | None = None) -> Column:
    """``fold_merges`` with the vocabulary at ``path``; without ``ranks``, its rank map is a literal."""
    tokens, pairs = vocabulary(path)
    return fold_merges(word, F.from_json(F.lit(json.dumps(_byte_ids(tokens))), "array<int>"), rank_map(pairs) if ranks is None else ranks)


def _frequent(counted: DataFrame, path: str, ranks: Column) -> Column:
    """One value, the ids of the most frequent words; at most ``FREQUENT`` short rows reach the driver."""
    top = cut(counted.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word"), "words")
    spread = top.repartition(top.sparkSession.sparkContext.defaultParallelism, "word")
    rows = _with_ids(spread, ranks, lambda r: folded(F.col("word"), path, r), ["word"]).collect()
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for r in rows:
        buckets[zlib.crc32(r["word"].encode()) & (BUCKETS - 1)][r["word"]] = r["ids"]
    return _value(counted.sparkSession, buckets, "array<map<string,array<int>>>", "frequent")


def _with_long(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``_long``: for every word of ``_words``, its ids if it is longer than ``LONG`` bytes."""
    tokens, pairs = vocabulary(path)
    byte_ids = _byte_ids(tokens)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                words = b.column(b.schema.get_field_index("_words"))[0].as_py()
                ids = [heap_merges(x, byte_ids, pairs) if len(x := w.encode("utf-8", "surrogatepass")) > LONG else None for w in words]
                yield b.append_column("_long", pa.array([ids], pa.list_(pa.list_(pa.int32()))))

    return df.mapInArrow(work, StructType(list(df.schema.fields)).add("_long", ArrayType(ArrayType(IntegerType()))))


def encode(df: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """``df`` with a column ``ids``, the token ids of the whole ``text``; an ``ids`` that it has already is replaced."""
    keep = [c for c in df.columns if c != "ids"]
    path = path or os.path.join(FOLDER, "byte_bpe_50k.tiktoken")
    split = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    counted = df.select(F.explode(split).alias("word")).filter(F.octet_length("word") <= FREQUENT_BYTES).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranks = _rank_value(df.sparkSession, path)
    known = F.struct(ranks.alias("ranks"), _frequent(counted, path, ranks).alias("frequent"))

    def ids(k: Column) -> Column:
        def usual(w: Column) -> Column:
            return F.get(k["frequent"], F.crc32(F.encode(w, "UTF-8")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))[w]

        def of(w: Column, i: Column) -> Column:
            return F.coalesce(usual(w), F.when(F.octet_length(w) <= LONG, folded(w, path, k["ranks"])).otherwise(F.get("_long", i)))

        return F.flatten(F.transform("_words", of))

    has_long = F.coalesce((F.octet_length(text) > LONG) & F.col(text).rlike(LONG_RUN), F.lit(False))
    rows = df.filter(~has_long).select(*keep, split.alias("_words")).withColumn("_long", F.lit(None).cast("array<array<int>>"))
    rows = rows.unionByName(_with_long(df.filter(has_long).select(*keep, split.alias("_words")), path))
    return _with_ids(rows, known, ids, keep)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of token ids: their binary pieces, concatenated."""
    tokens, _ = vocabulary(path or os.path.join(FOLDER, "byte_bpe_50k.tiktoken"))
    pieces = F.from_json(F.lit(json.dumps([t.hex() for t in tokens])), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")
