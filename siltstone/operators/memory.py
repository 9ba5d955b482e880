"""Votes of similar training questions for their relevant documents.

Questions are vectors of character n-grams inside words with smooth inverse
document frequencies fitted on the training questions only.  Pairs at or above
the threshold are found by prefix filtering: n-grams are ordered from rare to
frequent, and a pair that reaches the threshold shares an n-gram among the
leading ones whose remainder has a norm below it, on both sides.  So frequent
n-grams are never joined; candidates are verified on the whole vectors, where a
training vector lies, against blocks of query vectors in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as X
from siltstone.operators.ranking import best, steady
from siltstone.operators.vectors import within
from siltstone.storage import drop, new_path, settled

THRESHOLD = 0.82
BROADCAST_GRAMS, BLOCK, TASK = 200_000, 8192, 5000


def word_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of every word with a blank on either side; a short padded word counts once."""

    none = F.array().cast("array<string>")

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(w)
        def grams(n: int) -> Column:
            # Larger sizes only follow while the padded word is longer than the size before.
            cut = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
            return cut if n == low else F.when(size > n - 1, cut).otherwise(none)

        return F.flatten(F.array(*[grams(n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(F.filter(F.split(text, X.WS + "+"), lambda w: w != ""), of))


def counts(questions: DataFrame) -> DataFrame:
    """``part, query_id, g, tf`` of ``part, query_id, text``; the texts are shuffled, not their n-grams."""
    q = questions.select("part", "query_id", "text").repartition("part", "query_id")
    return q.select("part", "query_id", F.explode(word_grams(X.folded(F.col("text")))).alias("g")).groupBy("part", "query_id", "g").agg(F.count(F.lit(1)).alias("tf"))


def weighted(tf: DataFrame, df: DataFrame) -> DataFrame:
    """L2-normalised ``part, query_id, g, df, w, rest`` with sublinear counts; n-grams without ``part, g, df, n`` are dropped.

    ``rest`` is the squared norm of the vector's n-grams from the most frequent one up to this.
    """
    idf = F.ln((1.0 + F.col("n")) / (1 + F.col("df"))) + 1
    few = df.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    w = tf.join(F.broadcast(df) if few else df, ["part", "g"]).select("part", "query_id", "g", "df", ((1 + F.ln("tf")) * idf).alias("w"))
    whole = Window.partitionBy("part", "query_id").orderBy(F.desc("df"), F.desc("g"))
    square = F.sum(F.col("w") * F.col("w"))
    total = square.over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.withColumns({"total": total, "rest": square.over(whole.rowsBetween(Window.unboundedPreceding, 0))})
    return w.select("part", "query_id", "g", "df", (F.col("w") / F.sqrt("total")).alias("w"), (F.col("rest") / F.col("total")).alias("rest"))


def fitted(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the training questions, and ``part, g, df, n`` with the number of questions of the part; both written once."""
    tf = settled(counts(train), "grams")
    size = train.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("part", "g").agg(F.count(F.lit(1)).alias("df"))
    return tf, settled(df.join(F.broadcast(size), "part"), "vocabulary")  # one row a part


def vectors(w: DataFrame) -> DataFrame:
    """``part, query_id, h, w, rest`` with a vector a row; an n-gram and its part are a 64-bit hash.

    A pair that reaches the threshold shares an n-gram whose ``rest`` reaches
    its square on both sides.
    """
    w = w.filter("query_id is not null and part is not null").select("part", F.col("query_id").cast("string").alias("query_id"), F.struct(F.xxhash64("part", "g").alias("h"), "w", "rest").alias("x"))
    v = w.groupBy("part", "query_id").agg(F.collect_list("x").alias("x"))
    return v.select("part", "query_id", "x.h", "x.w", "x.rest")


def parted(questions: DataFrame) -> DataFrame:
    return questions if "part" in questions.columns else questions.withColumn("part", F.lit(0))


def similar(queries: DataFrame, train: DataFrame | None, threshold: float = THRESHOLD, stored: tuple[DataFrame, DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """``part, query_id, train_id, lexical`` of all pairs of different ids with cosine at least the threshold.

    Both sides have ``query_id, text`` and may have ``part``; only equal parts
    meet, and the vocabulary is fitted on the training questions of a part.
    ``stored`` is a memory that ``load`` read; it stands for ``train``.
    """
    if stored is None:
        tf, df = fitted(parted(train))
        t = settled(vectors(weighted(tf, df)), "weights")
        drop(tf.sparkSession, tf)
    else:
        t, df = stored
    # Candidates and whole vectors are compared where a training vector lies, so neither is written out or shuffled.
    blocks = max(1, -(-queries.count() // block))
    path = _blocked(vectors(weighted(counts(parted(queries)), df)), F.pmod(F.xxhash64("query_id"), F.lit(blocks)), blocks)

    def search(b: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = None
            for batch in batches:
                asked = asked or _Asked(f"{path}/block={b}", threshold)
                yield from asked.met(batch)

        return t.select("part", "query_id", "h", "w", "rest").mapInArrow(work, f"part {t.schema['part'].dataType.simpleString()}, query_id string, train_id string, lexical double")

    out = search(0)
    for b in range(1, blocks):
        out = out.unionByName(search(b))
    return out


def _blocked(q: DataFrame, block: Column, blocks: int) -> str:
    """The folder of query vectors in blocks."""
    path = new_path(q.sparkSession, "asked")
    q.withColumn("block", block.cast("int")).repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return path


def across_folds(held: DataFrame, train: DataFrame, folds: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """What ``similar`` finds if a question's part is its fold and a training question is in the parts of all other folds.

    Both sides have ``fold, query_id, text`` with one row a question.  The parts share nearly all of their
    questions, so these are written once: an n-gram's frequency in a part is that in all folds less the fold's
    own, and vectors are weighed where a question is read, for the one part of the block that they meet.
    """
    spark = train.sparkSession
    both = [df.select("fold", "query_id", "text", F.lit(mine).alias("held"), F.lit(not mine).alias("known")) for mine, df in ((True, held), (False, train))]
    t = settled(_grams(both[0].unionByName(both[1]).groupBy("fold", "query_id", "text").agg(F.max("held").alias("held"), F.max("known").alias("known")), train.count()), "grams")
    known = t.filter("known").select("fold", "query_id", "h", "tf")
    sizes = {r["fold"]: r["n"] for r in known.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a fold
    each = known.select("fold", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fold") == p).alias(f"own{p}") for p in range(folds)])
    vocabulary = new_path(spark, "vocabulary")
    each.select("h", "n", F.array(*[F.col("n") - F.col(f"own{p}") for p in range(folds)]).alias("df")).write.parquet(vocabulary)
    trained = [sum(k for f, k in sizes.items() if f != p) for p in range(folds)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = None
        for batch in batches:
            grams = grams or _Vocabulary(vocabulary, trained)
            for p in range(folds):
                yield from grams.weighed(batch, p, own=True)

    asked = t.filter("held").select("fold", "query_id", "h", "tf")
    each_part = max(1, -(-asked.count() // (folds * block)))
    path = _blocked(asked.mapInArrow(weigh, "part long, query_id string, h array<long>, w array<double>, rest array<double>"), F.col("part") * each_part + F.pmod(F.xxhash64("query_id"), F.lit(each_part)), folds * each_part)

    def search(b: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = grams = None
            for batch in batches:
                asked, grams = asked or _Asked(f"{path}/block={b}", threshold), grams or _Vocabulary(vocabulary, trained)
                for x in grams.weighed(batch, b // each_part, own=False):
                    yield from asked.met(x)

        return known.mapInArrow(work, "part long, query_id string, train_id string, lexical double")

    out = search(0)
    for b in range(1, folds * each_part):
        out = out.unionByName(search(b))
    return out


def _grams(questions: DataFrame, n: int) -> DataFrame:
    """``fold, query_id, held, known, h, tf`` of about ``n`` questions, a row each; an n-gram is a 64-bit hash."""
    q = questions.filter("fold is not null and query_id is not null").select(F.col("fold").cast("long").alias("fold"), F.col("query_id").cast("string").alias("query_id"), "held", "known", "text")
    tasks = max(2 * q.sparkSession.sparkContext.defaultParallelism, n // TASK)
    g = q.repartition(tasks, "query_id").select("fold", "query_id", "held", "known", F.transform(word_grams(X.folded(F.col("text"))), lambda x: F.xxhash64(x)).alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _slices(batch, 4):
                h, row = _flat(x.column(4)), _rows(x.column(4))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.nonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)])[0]
                tf = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([*x.columns[:4], *_lists(row[first], x.num_rows, h[first], tf)], ["fold", "query_id", "held", "known", "h", "tf"])

    return g.mapInArrow(count, "fold long, query_id string, held boolean, known boolean, h array<long>, tf array<long>")


def _slices(batch: pa.RecordBatch, column: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose lists have about ``most`` values."""
    piece = _starts(batch.column(column))[1:] // most
    for k in np.unique(piece):
        a, b = np.searchsorted(piece, [k, k + 1])
        yield batch.slice(a, b - a)


def _rows(column: pa.Array) -> np.ndarray:
    """The row of every value of the lists."""
    return np.repeat(np.arange(len(column)), np.diff(_starts(column)))


def _lists(row: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """Lists of ``n`` rows of values in the order of their rows."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


class _Vocabulary:
    """The n-grams of all folds with their frequency in each part."""

    def __init__(self, path: str, trained: list[int]):
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(path)
        x = ds.dataset(inner, filesystem=fs, format="parquet").to_table(columns=["h", "n", "df"])
        h = x["h"].to_numpy()
        order = np.argsort(h)
        self.h, self.n, self.df, self.trained = h[order], x["n"].to_numpy()[order], _flat(x["df"]).astype(np.int32).reshape(-1, len(trained))[order], trained

    def weighed(self, batch: pa.RecordBatch, part: int, own: bool) -> Iterator[pa.RecordBatch]:
        """``part, query_id, h, w, rest`` as ``vectors`` gives, of the questions in the part's own fold or outside it."""
        n = self.trained[part]
        for x in _slices(batch, 2):
            fold, h, row, tf = x.column(0).to_numpy(), _flat(x.column(2)), _rows(x.column(2)), _flat(x.column(3))
            take = np.nonzero(((fold == part) == own)[row])[0] if len(self.h) else np.zeros(0, np.int64)
            g = np.minimum(np.searchsorted(self.h, h[take]), len(self.h) - 1)
            there = (self.h[g] == h[take]) & (self.df[g, part] > 0)
            take, g = take[there], g[there]
            if not len(take):
                continue
            # From the most frequent n-gram of a question on; the order is the same on both sides.
            order = np.lexsort((g, -self.n[g], row[take]))
            take, g = take[order], g[order]
            rows, r = np.unique(row[take], return_inverse=True)
            w = (1 + np.log(tf[take])) * (np.log((1 + n) / (1 + self.df[g, part])) + 1)
            first = np.searchsorted(r, np.arange(len(rows)))
            total, sums = np.add.reduceat(w * w, first), np.cumsum(w * w)
            rest = sums - (sums - w * w)[first][r]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part)), x.column(1).take(pa.array(rows)), *_lists(r, len(rows), self.h[g], w / np.sqrt(total)[r], rest / total[r])], ["part", "query_id", "h", "w", "rest"])


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False)


def _starts(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(pc.list_value_length(column).to_pylist(), np.int64))]).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


class _Asked:
    """A block of query vectors with the places of every n-gram among their leading ones."""

    def __init__(self, path: str, threshold: float):
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(path)
        self.least, self.ids = threshold, np.zeros(0, object)
        if fs.get_file_info(inner).type == pafs.FileType.NotFound:
            return
        x = ds.dataset(inner, filesystem=fs, format="parquet").to_table(columns=["query_id", "h", "w", "rest"])
        self.ids, self.start, self.w = np.array(x["query_id"].to_pylist(), object), _starts(x["h"]), _flat(x["w"])
        self.known, self.g = np.unique(_flat(x["h"]), return_inverse=True)
        lead = np.nonzero(_flat(x["rest"]) >= threshold * threshold - 1e-9)[0]
        lead = lead[np.argsort(self.g[lead], kind="stable")]
        self.places = np.repeat(np.arange(len(self.ids)), np.diff(self.start))[lead]
        self.first = np.searchsorted(self.g[lead], np.arange(len(self.known) + 1))

    def met(self, batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
        if not len(self.ids):
            return
        names, start, h, w, rest = batch.column(1).to_pylist(), _starts(batch.column(2)), _flat(batch.column(2)), _flat(batch.column(3)), _flat(batch.column(4))
        g = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        same = self.known[g] == h
        dense, row_of = np.zeros(len(self.known)), np.repeat(np.arange(len(names)), np.diff(start))
        every = np.nonzero(same & (rest >= self.least * self.least - 1e-9))[0]
        sizes = self.first[g[every] + 1] - self.first[g[every]]
        # Rows are taken together as far as their shared leading n-grams stay within a bound.
        group = (np.cumsum(np.bincount(row_of[every], sizes, len(names))) // most).astype(np.int64)
        for k in np.unique(group):
            ours = group[row_of[every]] == k
            lead, size = every[ours], sizes[ours]
            pairs = np.unique(np.repeat(row_of[lead], size) * len(self.ids) + self.places[_ranges(self.first[g[lead]], size)])
            row, q = np.divmod(pairs, len(self.ids))
            found = [], [], []
            for i in np.unique(row):
                own = slice(start[i], start[i + 1])
                ok = same[own]
                dense[g[own][ok]] = w[own][ok]
                c = q[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
                n = self.start[c + 1] - self.start[c]
                of = _ranges(self.start[c], n)
                score = np.add.reduceat(self.w[of] * dense[self.g[of]], np.cumsum(n) - n)
                dense[g[own][ok]] = 0
                for j in np.nonzero(score >= self.least - 1e-9)[0]:
                    if self.ids[c[j]] != names[i]:
                        for column, x in zip(found, (i, self.ids[c[j]], score[j]), strict=True):
                            column.append(x)
            if found[0]:
                of = batch.take(pa.array(found[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([of.column(0), pa.array(found[1], pa.string()), of.column(1), pa.array(found[2], pa.float64())], ["part", "query_id", "train_id", "lexical"])


def save(train: DataFrame, path: str) -> None:
    """Store a fitted memory: the vectors of the training questions and the vocabulary."""
    tf, df = fitted(parted(train))
    df.write.mode("overwrite").parquet(f"{path}/vocabulary")
    vectors(weighted(tf, df)).write.mode("overwrite").parquet(f"{path}/weights")
    drop(tf.sparkSession, tf)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/vocabulary")


def both_arms(lexical: DataFrame, queries: DataFrame, train: DataFrame, threshold: float) -> DataFrame:
    """``query_id, train_id, lexical, dense`` of pairs that reach the lexical or the dense threshold; the other is null.

    ``lexical`` comes from ``similar``; ``queries`` and ``train`` have ``id, v``
    with unit vectors of the same encoder.
    """
    dense = within(queries, train, threshold).filter("query_id != chunk_id").select("query_id", F.col("chunk_id").alias("train_id"), F.col("score").alias("dense"))
    return lexical.select("query_id", "train_id", "lexical").join(dense, ["query_id", "train_id"], "full")


def votes(pairs: DataFrame, relevant: DataFrame, n_train: int, top_k: int = 5, lexical_weight: float = 1.0, dense_weight: float = 1.0) -> DataFrame:
    """Documents voted for by similar questions.

    ``pairs`` has ``query_id, train_id, lexical`` and may have ``dense``, each
    null or 0 where it stays under its threshold.
    """
    dense = F.coalesce("dense", F.lit(0.0)) if "dense" in pairs.columns else F.lit(0.0)
    p = pairs.select("query_id", "train_id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), dense.alias("dense"))
    p = p.withColumn("part", lexical_weight * F.col("lexical") + dense_weight * F.col("dense"))
    rows = p.join(relevant.select(F.col("query_id").alias("train_id"), "doc_id").distinct(), "train_id")
    g = rows.groupBy("query_id", "doc_id").agg(
        F.sum("part").alias("score"), F.max("lexical").alias("lexical_similarity"), F.max("dense").alias("dense_similarity"), F.count(F.lit(1)).alias("vote_count"),
        F.min(F.struct((-steady("part")).alias("p"), F.col("train_id").alias("matched_id")))["matched_id"].alias("matched_id"),
    )
    g = g.withColumn("positive_frequency", F.col("vote_count") / max(n_train, 1))
    return best(g, ["query_id"], [F.desc(steady("score")), F.asc("doc_id")], top_k)
