"""Exact matches between queries and legal documents.

Seeds come from equal numbers and from titles inside queries; only seeded
documents are enriched with flags, which never add a document.  A title inside
a query is found without comparing every title to every query: titles of up to
``SHORT`` characters are looked up among the query's substrings of their length,
longer ones by their last ``SHORT`` characters, followed by a test of the whole
title.  The query's substrings are looked up where its text lies, in blocks of
``BLOCK`` of these keys from the shared folder, so that only those that are the
key of a title are written or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.ranking import best, steady
from siltstone.storage import new_path, settled

SHORT, LEAST, BLOCK = 12, 7, 1_000_000
YEAR = r"(?U)\b(19[89]\d|20[012]\d)\b"
#: Weights of the flags in the composite score.
FLAGS = {"exact_legal_number": 3.0, "exact_title": 1.5, "exact_title_overlap": 1.0, "exact_article": 1.0, "exact_clause": 0.5, "exact_point": 0.5, "exact_year": 0.5, "exact_doc_type": 0.5}


def without_year(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(title, YEAR, ""), rf"^{X.WS}+|{X.WS}+$", "")


def digits_on(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^\d]*", "")


def number_index(docs: DataFrame) -> DataFrame:
    """``number, doc_id`` with the whole number and the part from its first digit."""
    n = docs.select("doc_id", F.replace(X.folded(F.col("legal_number")), F.lit("-"), F.lit("/")).alias("n")).filter("n != ''")
    return n.select(F.explode(F.array("n", digits_on(F.col("n")))).alias("number"), "doc_id").filter("number != ''").distinct()


def title_index(docs: DataFrame) -> DataFrame:
    """``title, doc_id, bare``: titles with and without their year, accented and (``bare``) unaccented."""
    t = docs.select("doc_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("name_raw")).alias("t"))
    forms = F.array(*[F.struct(form.alias("t"), F.lit(bare).alias("bare")) for bare, form in ((False, X.folded(F.col("t"))), (True, X.unaccented(F.col("t"))))])
    one = t.select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.t", "f.bare")
    return one.select(F.explode(F.array("t", without_year(F.col("t")))).alias("title"), "doc_id", "bare").filter(F.length("title") >= LEAST).distinct()


def _keys(path: str) -> dict[bool, set[str]]:
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    out: dict[bool, set[str]] = {False: set(), True: set()}
    fs, inner = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(inner).type != pafs.FileType.NotFound:
        for b in ds.dataset(inner, filesystem=fs, format="parquet").to_batches(columns=["bare", "key"]):
            for bare, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[bare].add(key)
    return out


def contained(queries: DataFrame, titles: DataFrame, block: int = BLOCK) -> DataFrame:
    """``query_id, title, bare`` of the titles inside each query's text; both sides have ``text`` or ``title`` and ``bare``."""
    # A key is as long as its title up to SHORT characters, so keys of different lengths never meet.
    t = settled(titles.filter((F.length("title") >= LEAST) & F.col("bare").isNotNull()).select("title", "bare").distinct().withColumn("key", F.right("title", F.lit(SHORT))), "titles")
    path, blocks = new_path(titles.sparkSession, "title-keys"), max(1, -(-t.count() // block))
    keys = t.select("bare", "key").distinct().withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    keys.repartition(blocks, "block").write.partitionBy("block").parquet(path)
    texts = queries.select("query_id", "bare", "text")

    def lookup(b: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None
            for batch in batches:
                if known is None:
                    known = _keys(f"{path}/block={b}")
                    sizes = {bare: sorted({len(k) for k in ks}) for bare, ks in known.items()}
                place, found = [], []
                for i, (bare, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    if bare is None or text is None:
                        continue
                    hits = {x for n in sizes[bare] for j in range(len(text) - n + 1) if (x := text[j : j + n]) in known[bare]}
                    place += [i] * len(hits)
                    found += hits
                if place:
                    rows = batch.take(pa.array(place, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], ["query_id", "bare", "text", "key"])

        return texts.mapInArrow(work, f"query_id {texts.schema['query_id'].dataType.simpleString()}, bare boolean, text string, key string")

    q = lookup(0)
    for b in range(1, blocks):
        q = q.unionByName(lookup(b))
    return q.join(t, ["bare", "key"]).filter(F.contains("text", F.col("title"))).select("query_id", "title", "bare").distinct()


def number_seeds(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, doc_id, seed`` of the numbers that ``query_id, question`` asks for."""
    question = F.col("question")
    loose = F.transform(F.regexp_extract_all(question, F.lit(X.LOOSE_NUMBER), F.lit(1)), lambda n: F.replace(X.folded(n), F.lit("-"), F.lit("/")))
    strict = F.transform(X.doc_numbers(X.clean(question)), lambda n: F.replace(F.lower(n), F.lit("-"), F.lit("/")))
    asked = settled(queries.select("query_id", F.explode(F.array_distinct(F.concat(loose, strict))).alias("number")), "asked")
    index = settled(number_index(docs), "numbers")
    whole = asked.join(index, "number").select("query_id", "doc_id", F.lit(1.0).alias("seed"))
    # The part from the first digit is looked up only for numbers that no document has.
    missed = asked.join(index.select("number").distinct(), "number", "left_anti").select("query_id", digits_on(F.col("number")).alias("number")).filter("number != ''")
    part = missed.join(index, "number").select("query_id", "doc_id", F.lit(0.9).alias("seed"))
    return whole.union(part).groupBy("query_id", "doc_id").agg(F.max("seed").alias("seed"))


def title_seeds(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, doc_id, seed, by_year`` of the titles inside ``query_id, question``, a row for either reason."""
    question = F.col("question")
    both = F.array(F.struct(F.lit(False).alias("bare"), X.folded(question).alias("text")), F.struct(F.lit(True).alias("bare"), X.unaccented(question).alias("text")))
    forms = queries.select("query_id", F.explode(both).alias("f")).select("query_id", "f.bare", "f.text")
    titles = settled(title_index(docs), "titles")
    inside = settled(contained(forms, titles), "inside")
    by_title = inside.join(titles, ["title", "bare"]).select("query_id", "doc_id", F.lit(0.85).alias("seed"), F.lit(False).alias("by_year")).distinct()
    years = queries.select("query_id", F.explode(X.years(X.clean(question))).alias("year"))
    # Titles without their year are titles of the index, so those inside a query are known.
    dated = docs.select("doc_id", F.trim("year").alias("year"), without_year(X.folded(F.col("title"))).alias("title")).filter(F.length("title") >= LEAST)
    by_year = inside.filter("not bare").join(years, "query_id").join(dated, ["title", "year"]).select("query_id", "doc_id", F.lit(0.95).alias("seed"), F.lit(True).alias("by_year"))
    return by_title.union(by_year)


def seeds(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, doc_id, seed, by_number, by_title, by_year`` of ``query_id, question``."""
    n = number_seeds(queries, docs).select("query_id", "doc_id", "seed", F.lit(True).alias("by_number"), F.lit(False).alias("by_title"), F.lit(False).alias("by_year"))
    t = title_seeds(queries, docs).select("query_id", "doc_id", "seed", F.lit(False).alias("by_number"), F.lit(True).alias("by_title"), "by_year")
    return n.union(t).groupBy("query_id", "doc_id").agg(F.max("seed").alias("seed"), F.max("by_number").alias("by_number"), F.max("by_title").alias("by_title"), F.max("by_year").alias("by_year"))


def labels(chunks: DataFrame) -> DataFrame:
    """``doc_id`` with the sets of article, clause and point labels of its chunks."""

    def both(c: str, word: str, pattern: str) -> Column:
        v = X.folded(F.col(c))
        rest = F.regexp_replace(v, pattern, "")
        return F.filter(F.array(v, F.when(rest != "", F.concat(F.lit(word + " "), rest))), lambda x: x.isNotNull() & (x != ""))

    rows = chunks.filter("doc_id is not null").select("doc_id", both("article", "điều", r"^[^\d]*").alias("a"), both("clause", "khoản", r"^[^\d]*").alias("c"), both("point", "điểm", r"(?U)^[^\w]*").alias("p"))
    return rows.groupBy("doc_id").agg(*[F.array_distinct(F.flatten(F.collect_set(x))).alias(n) for x, n in (("a", "articles"), ("c", "clauses"), ("p", "points"))])


def _hit(labels: str, signal: str, word: str) -> Column:
    return F.coalesce(F.exists(labels, lambda v: F.exists(signal, lambda s: F.contains(v, F.concat(F.lit(word + " "), s)) | (v == s))), F.lit(False))


def match(queries: DataFrame, docs: DataFrame, chunks: DataFrame, top_k: int | None = None) -> DataFrame:
    """Seeded documents of each query with flags, composite ``exact_score`` and ``score``, ranked."""
    queries = settled(queries.select("query_id", "question"), "queries")
    docs = settled(docs.select("doc_id", "title", "name_raw", "legal_number", "year", "doc_type"), "acts")
    question = F.col("question")
    x = X.clean(question)
    sig = queries.select(
        "query_id", F.transform(X.articles(x), F.lower).alias("qa"), F.transform(X.clauses(x), F.lower).alias("qc"), F.transform(X.points(x), F.lower).alias("qp"), X.years(x).alias("qy"),
        F.transform(F.regexp_extract_all(question, F.lit(X.DOC_TYPE), F.lit(1)), X.folded).alias("qt"), X.token_set(question).alias("tokens"),
    )
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("name_raw"))
    meta = docs.select("doc_id", F.trim("year").alias("year"), X.folded(F.col("doc_type")).alias("doc_type"), X.token_set(title).alias("tt"))
    found = settled(seeds(queries, docs), "seeds")
    # Only documents that were found need their chunks' labels.
    named = labels(chunks.join(found.select("doc_id").distinct(), "doc_id", "left_semi"))
    r = found.join(sig, "query_id").join(meta, "doc_id", "left").join(named, "doc_id", "left")
    overlap = F.when((F.size("tt") > 0) & (F.size("tokens") > 0), F.size(F.array_intersect("tt", "tokens")) / F.size("tt")).otherwise(0.0)
    r = r.withColumn("exact_title_overlap", F.coalesce(overlap, F.lit(0.0)))
    flags = {
        "exact_legal_number": F.col("by_number"), "exact_title": F.col("by_title") | (F.col("exact_title_overlap") > 0.6),
        "exact_article": _hit("articles", "qa", "điều"), "exact_clause": _hit("clauses", "qc", "khoản"), "exact_point": _hit("points", "qp", "điểm"),
        "exact_year": F.col("by_year") | F.coalesce(F.array_contains("qy", F.col("year")), F.lit(False)), "exact_doc_type": F.coalesce((F.col("doc_type") != "") & F.array_contains("qt", F.col("doc_type")), F.lit(False)),
    }
    r = r.select("query_id", "doc_id", "seed", "exact_title_overlap", *[c.alias(k) for k, c in flags.items()])
    score = sum((F.col(k).cast("double") * w for k, w in FLAGS.items()), F.lit(0.0))
    r = r.withColumn("exact_score", score).withColumn("score", F.greatest("seed", "exact_score"))
    return best(r, ["query_id"], [F.desc(steady("score")), F.asc("doc_id")], top_k or 2**31 - 1)
