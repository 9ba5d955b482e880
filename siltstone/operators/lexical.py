"""Fielded BM25 over chunks, for whole sets of queries at once.

The index is two tables: postings ``term, chunk_id, doc_id, tf, len`` and the
corpus size with the mean length.  A chunk's bag holds the tokens of a field as
often as the whole part of the field's weight says.  Scoring joins the query
terms to the postings on the term; the sum by query and chunk aggregates before
its shuffle.

Searches for the best chunks alone (``top``) read one row a chunk, once: its
terms that any query asks for are written as numbers into the shared folder.  A
task then scores a block of queries on all chunks, or on a part of them where
there are few queries, and hands on the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.skew import salted_join
from siltstone.operators.ranking import best, roll_up, steady
from siltstone.storage import cut, new_path

K1, B = 1.5, 0.75
BROADCAST_TERMS = 100_000
#: Best chunks of all queries of a block that a task holds.
HELD = 400_000
#: Tokens, and kept rows beside the best, that a task has in hand at a time; its scores at a time; queries of a block where tasks would be too few.
PIECE, SCORES, FEW = 200_000, 1_000_000, 32
#: Share of all pairs of a row and a query from which a term is often met.
OFTEN = 0.03
#: Fields that come from a chunk's document.
OF_DOCUMENT = ("legal_number", "title", "slug")
#: Field weights, of which the whole part counts, and boosts for legal signals.
FIELD_WEIGHTS = {"body": 1.0, "legal_number": 5.0, "title": 3.0, "article": 2.5, "clause": 1.5, "slug": 1.5}
SEGMENTED_WEIGHTS = {"body": 1.0, "legal_number": 4.0, "title": 3.0, "article": 2.0, "clause": 1.0, "slug": 1.0}
BOOSTS = {"legal_number": 6.0, "article": 3.0, "clause": 1.5, "point": 0.75, "year": 1.0, "doc_type": 1.0}


@dataclass
class Index:
    postings: DataFrame
    n: int
    mean_length: float


@dataclass
class Bags:
    """An index of one row a chunk: ``chunk_id, doc_id, len``, its tokens ``t`` and their weights ``w``.

    With ``weights``, ``t`` is a list of tokens a field, in their order, and
    neither ``len`` and ``w`` nor the corpus numbers are known before a search.
    """

    rows: DataFrame
    n: int | None = None
    mean_length: float | None = None
    weights: tuple[int, ...] | None = None


def enriched(chunks: DataFrame, docs: DataFrame, tokens: dict | None = None) -> DataFrame:
    """Chunks with their document's title, number, link, year and kind (null without a document).

    A column that the chunks have already is kept unless it is null or blank in
    every row; its name in another case counts as the same column.  ``tokens``
    names columns for the tokens of the document's fields by each of its
    functions, which are split once a document where the chunks have none.
    """
    names = ("title", "legal_number", "link", "year", "doc_type")
    have = {c.lower(): c for c in chunks.columns}
    given = {c: have[c] for c in names if c in have}
    if given:
        full = chunks.agg(*[F.max(F.trim(F.col(own).cast("string")) != "").alias(c) for c, own in given.items()]).first()
        empty = [own for c, own in given.items() if not full[c]]
        chunks, given = chunks.drop(*empty), {c: own for c, own in given.items() if full[c]}
    split = [F.array(*[fields(f)[k] for k in OF_DOCUMENT]).alias(name) for name, f in (tokens or {}).items()]
    if given:
        return chunks.join(docs.select("doc_id", *[c for c in names if c not in given]), "doc_id", "left").select("*", *split)
    out = chunks.join(docs.select("doc_id", *names, *split), "doc_id", "left")
    none = F.array(*[F.array().cast("array<string>") for _ in OF_DOCUMENT])
    return out.withColumns({name: F.coalesce(name, none) for name in tokens}) if tokens else out


def fields(tokens=X.legal_tokens) -> dict[str, Column]:
    """Token arrays by field of enriched chunks."""
    body = F.coalesce(F.when(F.col("text_norm") != "", F.col("text_norm")), F.col("text_raw"))
    slug = F.replace(X.slug(F.col("link")), F.lit("-"), F.lit(" "))
    return {"body": tokens(body), "legal_number": tokens(F.col("legal_number")), "title": tokens(F.col("title")), "article": tokens(F.col("article")), "clause": tokens(F.col("clause")), "slug": tokens(slug)}


def build(chunks: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS, tokens=X.legal_tokens) -> Index:
    """The index of enriched chunks."""
    f = {k: c for k, c in fields(tokens).items() if int(weights.get(k, 0)) > 0}
    rows = chunks.select("chunk_id", "doc_id", F.array(*[F.struct(F.lit(int(weights[k])).alias("w"), c.alias("t")) for k, c in f.items()]).alias("f"))
    length = F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x["w"] * F.size(x["t"]))
    rows = rows.withColumn("len", length)
    each = rows.select("chunk_id", "doc_id", "len", F.explode("f").alias("f")).select("chunk_id", "doc_id", "len", "f.w", F.explode("f.t").alias("term"))
    # Written once: texts are split into tokens in one pass, whatever reads the index.
    postings = cut(each.groupBy("chunk_id", "doc_id", "len", "term").agg(F.sum("w").cast("long").alias("tf")), "postings")
    n, total = chunks.count(), postings.agg(F.sum("tf")).first()[0] or 0
    return Index(postings, n, total / n if total else 1.0)


def bagged(chunks: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS, tokens=X.legal_tokens) -> DataFrame:
    """The rows of ``Bags`` of enriched chunks."""
    f = [(int(weights[k]), c) for k, c in fields(tokens).items() if int(weights.get(k, 0)) > 0]
    rows = chunks.select("chunk_id", "doc_id", F.array(*[F.struct(F.lit(w).alias("w"), F.coalesce(c, F.array().cast("array<string>")).alias("t")) for w, c in f]).alias("f"))
    rows = rows.select("chunk_id", "doc_id", F.flatten("f.t").alias("t"), F.flatten(F.transform("f", lambda x: F.transform(x["t"], lambda _: x["w"]))).alias("w"))
    return rows.withColumn("len", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x))


def query_terms(queries: DataFrame, column: str, tokens=X.legal_tokens) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col(column))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scores(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, chunk_id, doc_id, raw_score`` of every chunk that shares a term with a query."""
    terms = cut(terms, "terms")
    # A bounded set of query terms goes to every task, so that a chunk's terms are summed where its postings lie;
    # a larger one is joined by a shuffle on the term, in which frequent terms are spread.
    small = terms.count() <= BROADCAST_TERMS

    def met(t: DataFrame, how: str) -> DataFrame:
        return index.postings.join(F.broadcast(t), "term", how) if small else salted_join(index.postings, t, ["term"], ["chunk_id"], how)

    df = met(terms.select("term").distinct(), "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    q = terms.join(df, "term").select("query_id", "term", (idf * F.col("qtf")).alias("w"))
    tf, length = F.col("tf"), F.col("len")
    part = F.col("w") * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (length / index.mean_length)))
    return met(q, "inner").groupBy("query_id", "chunk_id", "doc_id").agg(F.sum(part).alias("raw_score"))


def cut_off(scored: DataFrame, top_k: int) -> DataFrame:
    """The ``max(10 * top_k, 100)`` best chunks of each query by raw score."""
    return best(scored.filter("raw_score > 0"), ["query_id"], [F.desc(steady("raw_score")), F.asc("chunk_id")], max(10 * top_k, 100), "chunk_rank")


def by_field(chunks: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS, tokens=X.legal_tokens, split: str | None = None) -> Bags:
    """An index of enriched chunks for one search, which is not written; ``split`` is a column of ``enriched``'s ``tokens``."""
    f = {k: c for k, c in fields(tokens).items() if int(weights.get(k, 0)) > 0}
    if split:
        f |= {k: F.get(split, F.lit(i)) for i, k in enumerate(OF_DOCUMENT) if k in f}
    none = F.array().cast("array<string>")
    return Bags(chunks.select("chunk_id", "doc_id", F.array(*[F.coalesce(c, none) for c in f.values()]).alias("t")), weights=tuple(int(weights[k]) for k in f))


def top(index: Bags, terms: DataFrame, top_k: int, k1: float = K1, b: float = B, held: int = HELD) -> DataFrame:
    """``cut_off`` of ``scores``: only the best chunks of a task are shuffled, not all that share a term with a query."""
    spark, most, terms = index.rows.sparkSession, max(10 * top_k, 100), cut(terms, "terms")
    words = new_path(spark, "words")
    terms.select("term").distinct().write.parquet(words)
    rows = index.rows.select("chunk_id", "doc_id", "t") if index.weights else index.rows.select("chunk_id", "doc_id", "t", "len", "w")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")} | {"query_id": terms.schema["query_id"].dataType.simpleString()}
    weights = index.weights

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            known = _words(words) if known is None else known
            yield from _coded(batch, known, weights)

    path = new_path(spark, "met")
    rows.mapInArrow(code, f"chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, len long, c array<int>, tf array<long>").write.parquet(path)
    met = spark.read.parquet(path)
    n, mean = index.n, index.mean_length
    if weights:
        s = met.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).first()
        n, mean = s["n"], s["total"] / s["n"] if s["total"] else 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(words)
        df = np.zeros(len(known), np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(known))
        there = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([known.take(pa.array(there)), pa.array(df[there])], ["term", "df"])

    df = met.select("c").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    asking, tasks = terms.select("query_id").distinct().count(), 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-asking * most // held), min(tasks, -(-asking // FEW)))
    parts = -(-tasks // blocks)
    q = terms.join(df, "term").select("query_id", "term", (idf * F.col("qtf")).alias("w"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = new_path(spark, "asked")
    q.repartition(blocks, "block").write.partitionBy("block").parquet(asked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                block, part = divmod(task, parts)
                best_of = _Top(f"{asked}/block={block}", words, most, k1, b, mean)
                for x in _part(path, part, parts) if len(best_of.ids) else ():
                    best_of.add(x)
                yield from best_of.rows()

    out = spark.range(0, blocks * parts, 1, blocks * parts).mapInArrow(work, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, doc_id {kinds['doc_id']}, raw_score double")
    return cut_off(out, top_k)


def _words(path: str) -> pa.Array:
    """The terms of all queries in order; a term's place is its number."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path)
    x = ds.dataset(inner, filesystem=fs, format="parquet", schema=pa.schema([("term", pa.string())])).to_table()["term"].combine_chunks().drop_null()
    return x.take(pc.sort_indices(x))


def _part(path: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of every ``parts``-th file."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path)
    files = sorted(ds.dataset(inner, filesystem=fs, format="parquet").files)[part::parts]
    if files:
        yield from ds.dataset(files, filesystem=fs, format="parquet").to_batches(columns=["chunk_id", "doc_id", "len", "c", "tf"], batch_size=16_384, batch_readahead=1, fragment_readahead=1, use_threads=False)


def _coded(batch: pa.RecordBatch, known: pa.Array, weights: tuple[int, ...] | None) -> Iterator[pa.RecordBatch]:
    """``chunk_id, doc_id, len, c, tf`` of rows of an index: the numbers of their known terms and how often they weigh."""
    t = batch.column(2)
    sizes = pc.list_value_length(t.flatten() if weights else t).to_numpy()
    if weights:
        sizes = sizes.reshape(-1, len(weights))
        length = sizes @ np.array(weights, np.int64)
        each = sizes.sum(axis=1)
    else:
        length, each = batch.column(3).to_numpy(), sizes
    # Long batches are cut, so that what a piece needs beside it stays small.
    piece = np.cumsum(each) // PIECE
    for k in np.unique(piece):
        low, high = np.searchsorted(piece, [k, k + 1])
        x = batch.slice(low, high - low)
        tokens = x.column(2).flatten()
        code = pc.index_in(tokens.flatten() if weights else tokens, value_set=known).fill_null(-1).to_numpy()
        w = np.repeat(np.tile(np.array(weights, np.int64), high - low), sizes[low:high].ravel()) if weights else x.column(4).flatten().to_numpy()
        there = np.nonzero(code >= 0)[0]
        key, place = np.unique(np.repeat(np.arange(high - low), each[low:high])[there] * max(len(known), 1) + code[there], return_inverse=True)
        row, c = np.divmod(key, max(len(known), 1))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=high - low))]).astype(np.int32))
        tf = np.bincount(place, w[there], len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(length[low:high], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf))], ["chunk_id", "doc_id", "len", "c", "tf"])


class _Top:
    """The best chunks of a block of queries among the rows of a task."""

    def __init__(self, path: str, words: str, most: int, k1: float, b: float, mean: float):
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        self.most, self.k1, self.b, self.mean, self.kept, self.new, self.ids = most, k1, b, mean, [], 0, pa.array([], pa.string())
        fs, inner = pafs.FileSystem.from_uri(path)
        if fs.get_file_info(inner).type == pafs.FileType.NotFound:
            return
        x = ds.dataset(inner, filesystem=fs, format="parquet").to_table(columns=["query_id", "term", "w"])
        query, known = x["query_id"].combine_chunks().dictionary_encode(null_encoding="encode"), _words(words)
        self.ids, code = query.dictionary, pc.index_in(x["term"].combine_chunks(), value_set=known).to_numpy()
        order = np.argsort(code, kind="stable")
        self.q, self.weight = query.indices.to_numpy()[order], x["w"].to_numpy()[order]
        terms, first = np.unique(code[order], return_index=True)
        self.first, self.own = np.append(first, len(code)), np.full(len(known), -1, np.int32)
        self.own[terms] = np.arange(len(terms))
        #: The best scores of each query so far, and what a chunk needs to be among them.
        self.scores, self.least = [np.zeros(0)] * len(self.ids), np.zeros(len(self.ids))

    def add(self, batch: pa.RecordBatch) -> None:
        step = max(1, SCORES // len(self.ids))
        for low in range(0, batch.num_rows, step):
            self._add(batch.slice(low, step))

    def _add(self, batch: pa.RecordBatch) -> None:
        n, c = batch.num_rows, self.own[batch.column(3).flatten().to_numpy()]
        there = np.nonzero(c >= 0)[0]
        there = there[np.argsort(c[there].astype(np.int16) if len(self.first) < 2**15 else c[there], kind="stable")]
        c, row, tf = c[there], np.repeat(np.arange(n), pc.list_value_length(batch.column(3)).to_numpy())[there], batch.column(4).flatten().to_numpy()[there]
        part = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * (batch.column(2).to_numpy()[row] / self.mean)))
        starts = np.nonzero(np.diff(c, prepend=-1))[0]
        ends, t = np.append(starts[1:], len(c)), c[starts]
        # Terms of many rows and queries are a product of matrices, the others are added row by row.
        often = (ends - starts) * (self.first[t + 1] - self.first[t]) > OFTEN * n * len(self.ids)
        weights, parts = np.zeros((len(self.ids), often.sum())), np.zeros((often.sum(), n))
        for d, at in enumerate(np.nonzero(often)[0]):
            k = slice(self.first[t[at]], self.first[t[at] + 1])
            weights[self.q[k], d] = self.weight[k]
            parts[d, row[starts[at] : ends[at]]] = part[starts[at] : ends[at]]
        score = weights @ parts
        for at in np.nonzero(~often)[0]:
            rows, values = row[starts[at] : ends[at]], part[starts[at] : ends[at]]
            for k in range(self.first[t[at]], self.first[t[at] + 1]):
                score[self.q[k], rows] += self.weight[k] * values
        # A row is in a term's rows once, so no sum is lost.
        q, r = np.nonzero((score > 0) & (score >= self.least[:, None] - 2e-9))
        s = score[q, r]
        for k, own in zip(found := np.unique(q), np.split(s, np.searchsorted(q, found)[1:]), strict=True):
            own = np.concatenate([self.scores[k], own])
            if len(own) >= self.most:
                own = np.partition(own, len(own) - self.most)[-self.most :]
                self.least[k] = own.min()
            self.scores[k] = own
        ok = s >= self.least[q] - 2e-9
        q, r, s = q[ok], r[ok], s[ok]
        chosen = batch.select([0, 1]).take(pa.array(r))
        self.kept.append(pa.table({"q": q, "chunk_id": chosen.column(0), "doc_id": chosen.column(1), "raw_score": s}))
        self.new += len(r)
        if self.new > len(self.ids) * self.most + PIECE:
            self.compact()

    def compact(self) -> None:
        x = pa.concat_tables(self.kept)
        x = x.filter(pa.array(x["raw_score"].to_numpy() >= self.least[x["q"].to_numpy()] - 2e-9))
        x = x.append_column("s", pa.array(np.round(x["raw_score"].to_numpy(), 9)))
        x = x.take(pc.sort_indices(x, sort_keys=[("q", "ascending"), ("s", "descending"), ("chunk_id", "ascending")], null_placement="at_start"))
        q = x["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.kept, self.new = [x.filter(pa.array(place < self.most)).drop_columns(["s"])], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.kept:
            return
        self.compact()
        for x in self.kept[0].combine_chunks().to_batches(100_000):
            yield pa.RecordBatch.from_arrays([self.ids.take(x.column(0)), *x.columns[1:]], ["query_id", "chunk_id", "doc_id", "raw_score"])


def query_signals(queries: DataFrame, column: str) -> DataFrame:
    """``query_id`` and the lower-case signals that boosts compare."""
    x = X.clean(F.col(column))
    low = {"numbers": F.transform(X.doc_numbers(x), lambda v: F.replace(F.lower(v), F.lit("-"), F.lit("/"))), "articles": F.transform(X.articles(x), F.lower), "clauses": F.transform(X.clauses(x), F.lower), "points": F.transform(X.points(x), F.lower)}
    return queries.select("query_id", *[c.alias(f"q_{k}") for k, c in low.items()], X.years(x).alias("q_years"), X.doc_types(F.col(column)).alias("q_types"))


def _stripped(c: str) -> Column:
    return F.trim(X.nfc(X.text(F.col(c))))


def boost(weights: dict[str, float] = BOOSTS) -> Column:
    """Additive boost of a chunk row that carries query signals and document fields."""
    number = F.replace(F.lower(_stripped("legal_number")), F.lit("-"), F.lit("/"))

    def labelled(field: str, signal: str, word: str) -> Column:
        v = F.lower(_stripped(field))
        return F.exists(signal, lambda s: F.contains(v, F.concat(F.lit(word + " "), s)) | F.contains(v, F.concat(F.lit(word + "_"), s)) | (v == s))

    tests = {
        "legal_number": (number != "") & F.exists("q_numbers", lambda n: F.contains(number, n)),
        "article": labelled("article", "q_articles", "điều"), "clause": labelled("clause", "q_clauses", "khoản"), "point": labelled("point", "q_points", "điểm"),
        "year": F.array_contains("q_years", _stripped("year")), "doc_type": F.array_contains("q_types", F.lower(_stripped("doc_type"))),
    }
    return sum((F.when(t, F.lit(weights[k])).otherwise(0.0) for k, t in tests.items()), F.lit(0.0))


def boosted(kept: DataFrame, chunks: DataFrame, signals: DataFrame, weights: dict[str, float] = BOOSTS) -> DataFrame:
    """Cut-off chunks with ``boost`` and ``score``; a boost never brings back a chunk below the cut."""
    meta = chunks.select("chunk_id", "article", "clause", "point", "legal_number", "year", "doc_type")
    rows = kept.join(meta, "chunk_id").join(signals, "query_id")
    b = boost(weights)
    return rows.select("query_id", "chunk_id", "doc_id", "raw_score", b.alias("boost"), (F.col("raw_score") + b).alias("score"))


def documents(scored: DataFrame, top_k: int) -> DataFrame:
    """Ranked documents of chunk scores with the greatest boost of their chunks."""
    return best(roll_up(scored), ["query_id"], [F.desc(steady("score")), F.asc("doc_id")], top_k)


def search(chunks: DataFrame, queries: DataFrame, column: str, top_k: int = 100, weights: dict[str, float] = FIELD_WEIGHTS, tokens=X.legal_tokens, boosts: dict[str, float] | None = BOOSTS, split: str | None = None) -> DataFrame:
    """Index enriched chunks, score all queries and return ranked documents."""
    kept = top(by_field(chunks, weights, tokens, split), query_terms(queries, column, tokens), top_k)
    scored = boosted(kept, chunks, query_signals(queries, column), boosts) if boosts else kept.withColumn("score", F.col("raw_score"))
    return documents(scored.filter("doc_id is not null"), top_k)
