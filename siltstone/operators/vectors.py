"""Exact vector search of a stated query set against all rows, in blocks.

Query vectors are written to the shared folder in blocks of ``BLOCK`` rows.  Each
block is one pass over the base vectors, reads its own folder alone, and
multiplies every Arrow batch with the block; each task keeps the best ``k`` base
rows a query, so the final ranking shuffles at most ``k`` rows a query and task.  Neither side is
broadcast by Spark and no pair is written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import unit_vector
from siltstone.operators.ranking import best, roll_up, steady
from siltstone.storage import new_path

BLOCK = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _read(path: str) -> pa.Table | None:
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(inner).type == pafs.FileType.NotFound:
        return None
    return ds.dataset(inner, filesystem=fs, format="parquet").to_table(columns=["id", "v"])


def _finite(df: DataFrame) -> DataFrame:
    return df.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _blocks(queries: DataFrame, block: int) -> tuple[str, int]:
    """Query vectors in the shared folder, a folder a block of about ``block`` rows; a task reads no other."""
    blocks = max(1, -(-queries.count() // block))
    path = new_path(queries.sparkSession, "query-vectors")
    rows = _finite(queries.select("id", "v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    rows.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return path, blocks


class _Best:
    """The ``k`` best rows of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.s, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores (row, query) of more rows; only rows that reach the present k-th score are sorted."""
        keep = scores >= self.floor - 1e-9
        if len(ids) > self.k:
            keep &= scores >= np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k] - 1e-9
        row, q = np.nonzero(keep)
        if not len(row):
            return
        q, s, x = np.concatenate([self.q, q]), np.concatenate([self.s, scores[row, q]]), np.concatenate([self.ids, ids[row]])
        names = np.unique(x.astype(str), return_inverse=True)[1]
        order = np.lexsort((names, -np.round(s, 9), q))
        q, s, x = q[order], s[order], x[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = q[place == self.k - 1]
        self.floor[full] = s[place == self.k - 1]
        few = place < self.k
        self.q, self.s, self.ids = q[few], s[few], x[few]


def _searched(queries: DataFrame, base: DataFrame, block: int, new) -> DataFrame:
    """Union over the blocks of one pass each over ``base``; ``new(qids)`` makes a collector with ``add`` and ``rows``."""
    path, blocks = _blocks(queries, block)
    rows = _finite(base.select("id", "v"))

    def search(b: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = _read(f"{path}/block={b}")
            if t is None or not t.num_rows:
                return
            qids, q = np.array(t["id"].to_pylist(), dtype=object), _matrix(t["v"].combine_chunks())
            take = new(len(qids))
            for batch in batches:
                if batch.num_rows:
                    yield from _pairs(qids, take(np.array(batch.column(0).to_pylist(), dtype=object), _matrix(batch.column(1)) @ q.T))
            yield from _pairs(qids, take(None, None))

        return rows.mapInArrow(work, "query_id string, chunk_id string, score double")

    out = search(0)
    for b in range(1, blocks):
        out = out.unionByName(search(b))
    return out


def _pairs(qids: np.ndarray, got) -> Iterator[pa.RecordBatch]:
    if got is not None and len(got[0]):
        q, x, s = got
        yield pa.RecordBatch.from_arrays([pa.array(qids[q].tolist(), pa.string()), pa.array(x.tolist(), pa.string()), pa.array(s)], ["query_id", "chunk_id", "score"])


def nearest(queries: DataFrame, base: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``query_id, chunk_id, score, chunk_rank``: the ``k`` base vectors of greatest inner product.

    Both sides have ``id string, v array<double>`` of one length; null vectors
    and vectors that hold a value that is no finite number take no part.  Ties
    go to the smaller id.
    """

    def new(n: int):
        kept = _Best(n, k)

        def take(ids, scores):
            if ids is None:
                return kept.q, kept.ids, kept.s
            kept.add(ids, scores)

        return take

    return best(_searched(queries, base, block, new), ["query_id"], [F.desc(steady("score")), F.asc("chunk_id")], k, "chunk_rank")


def within(queries: DataFrame, base: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``query_id, chunk_id, score`` of all pairs whose inner product is at least the threshold; input as of ``nearest``."""

    def new(n: int):
        def take(ids, scores):
            if ids is not None:
                row, q = np.nonzero(scores >= threshold - 1e-9)
                return q, ids[row], scores[row, q]

        return take

    return _searched(queries, base, block, new)


def dense_search(queries: DataFrame, base: DataFrame, top_k: int) -> DataFrame:
    """Ranked documents by their chunks' unit vectors: the best ``max(6 * top_k, top_k)`` chunks, rolled up.

    ``base`` has ``id, doc_id, v``.
    """
    q = queries.select("id", unit_vector(F.col("v")).alias("v"))
    near = nearest(q, base.select("id", unit_vector(F.col("v")).alias("v")), 6 * top_k)
    docs = near.join(base.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id")
    return best(roll_up(docs), ["query_id"], [F.desc(steady("score")), F.asc("doc_id")], top_k)


def hashed_vectors(texts: DataFrame, sizes: tuple[int, int] = (3, 5), buckets: int = 256) -> DataFrame:
    """``id, bucket, w``: L2-normalised counts of a text's character n-grams in md5 buckets.

    A stand-in encoder that needs no model.  The bucket is the first byte of the
    n-gram's md5, so that another engine can repeat it.
    """
    if buckets != 256:
        raise ValueError("the bucket is one byte")
    text = F.col("text")

    def grams(n: int):
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    each = texts.filter("text is not null").select("id", F.explode(F.flatten(F.array(*[grams(n) for n in range(sizes[0], sizes[1] + 1)]))).alias("g"))
    counts = each.groupBy("id", F.conv(F.substring(F.md5("g"), 1, 2), 16, 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))
    return counts.filter("id is not null").select("id", "bucket", (F.col("n") / length).alias("w"))


def dense_rows(hashed: DataFrame, buckets: int = 256) -> DataFrame:
    """``id, v`` with whole vectors of ``id, bucket, w``; a row has at most ``buckets`` entries."""
    m = hashed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))


def encoded(texts: DataFrame, encode, text: str = "text") -> DataFrame:
    """``texts`` with ``v``, unit vectors of an encoder over batches of texts, shortest first within a batch."""
    from pyspark.sql import types as T

    at = texts.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [x or "" for x in b.column(at).to_pylist()]
            order = sorted(range(len(values)), key=lambda i: len(values[i]))
            v = np.asarray(encode([values[i] for i in order]), dtype=np.float64)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            unit = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
            back = np.empty_like(unit)
            back[order] = unit
            yield b.append_column("v", pa.array(back.tolist(), pa.list_(pa.float64())))

    return texts.mapInArrow(work, T.StructType([*texts.schema.fields, T.StructField("v", T.ArrayType(T.DoubleType()))]))
