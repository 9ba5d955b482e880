"""Measures of ranked answers against relevant documents, and validation of tables and answers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ranking import best
from siltstone.operators.skew import salted_join

CUTOFFS = (20, 50, 100, 150, 200)


def cutoffs(values=None) -> list[int]:
    """Positive whole cut-offs without repeats, in the caller's order."""
    out: list[int] = []
    for v in CUTOFFS if values is None else values:
        if isinstance(v, bool) or int(v) != v or v <= 0:
            raise ValueError("a cut-off is a positive whole number")
        if int(v) not in out:
            out.append(int(v))
    return out


def gold_sizes(relevant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct relevant ``query_id, doc_id``, and their number a query as ``n``; no list of a query's documents is built."""
    gold = relevant.select("query_id", "doc_id").dropna().distinct()
    return gold, gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def per_query(answers: DataFrame, relevant: DataFrame, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Measures of every query with relevant documents.

    ``answers`` has ``query_id, answer``.  A missing answer and one with none or
    more than five documents count 0.  Precision divides by the raw length,
    repeats included.
    """
    gold, size = gold_sizes(relevant)
    ok = answers.filter(F.size("answer").between(1, 5)).select("query_id", "answer", F.size("answer").alias("len"))
    placed = ok.select("query_id", "len", F.posexplode("answer").alias("i", "doc_id"))
    hits = placed.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((F.col("i") + 1).alias("i"), "doc_id"))).alias("hits"))  # five at most
    g = size.join(ok.select("query_id", "len"), "query_id", "left").join(hits, "query_id", "left")
    none = F.array().cast("array<struct<i:int,doc_id:string>>")
    g = g.withColumn("hits", F.coalesce("hits", none))
    n = F.col("n")
    upto = lambda k: F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: h["i"] <= k), lambda h: h["doc_id"])))
    cols: dict[str, Column] = {"recall": upto(5) / n, "precision": upto(5) / F.col("len")}
    for k in at:
        cols[f"recall_at_{k}"] = upto(k) / n
        cols[f"precision_at_{k}"] = upto(k) / F.least("len", F.lit(k))
    cols["mrr"] = F.coalesce(1.0 / F.get("hits", F.lit(0))["i"], F.lit(0.0))
    add = lambda f: F.aggregate(F.transform("hits", f), F.lit(0.0), lambda s, x: s + x)
    cols["map"] = add(lambda h, j: (j + 1) / h["i"]) / n  # the running number of hits over the place of each
    ideal = F.array(*[F.lit(sum(1 / math.log2(j + 1) for j in range(1, i + 1))) for i in range(1, 6)])
    cols["ndcg_at_5"] = add(lambda h: 1 / F.log2(h["i"] + 1.0)) / F.get(ideal, (F.least(n, F.lit(5)) - 1).cast("int"))
    return g.select("query_id", *[F.when(F.col("len").isNotNull(), c).otherwise(0.0).alias(k) for k, c in cols.items()])


def means(measures: DataFrame, by: list[str] = ()) -> DataFrame:
    """Macro averages over queries and their number."""
    names = [c for c, t in measures.dtypes if t == "double" and c not in by]
    return measures.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names], F.count(F.lit(1)).alias("n_queries"))


def over_folds(fold_means: DataFrame, names: list[str]) -> DataFrame:
    """``measure, mean, std`` over folds with the population deviation."""
    rows = fold_means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in names])).alias("x")).select("x.*")
    return rows.groupBy("measure").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))


def official(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean recall over the truth's ids and mean precision over the answered ids; both sides must have as many ids."""
    n = [df.select("query_id").distinct().count() for df in (answers, truth)]
    if n[0] != n[1]:
        raise ValueError(f"{n[0]} answers for {n[1]} queries")
    m = per_query(answers, truth)
    return m.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))


def ranking_measures(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Recall, reciprocal rank, first hit and gain at ``k`` of ``query_id, doc_id, rank`` without a limit on the length.

    Repeats are dropped first.  The mean is over queries with relevant documents.
    """
    one = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    gold, size = gold_sizes(relevant)
    top = best(one, ["query_id"], [F.asc("r"), F.asc("doc_id")], k, "i").join(gold, ["query_id", "doc_id"], "left_semi")
    hit = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("i").alias("first"), F.sum(1 / F.log2(F.col("i") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    g = size.join(hit, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.agg(F.avg(zero(F.col("hits") / F.col("n"))).alias("recall"), F.avg(zero(1 / F.col("first"))).alias("mrr"), F.avg(zero((F.col("first") == 1).cast("double"))).alias("hit1"), F.avg(zero(F.col("dcg") / ideal)).alias("ndcg"), F.count(F.lit(1)).alias("n_queries"))


def candidate_recall(candidates: DataFrame, relevant: DataFrame, at=None) -> DataFrame:
    """``cutoff, recall, any_hit, n_queries``: share of relevant documents, and of queries with any, among the first candidates."""
    gold = relevant.select("query_id", "doc_id").dropna().distinct()
    size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    best = candidates.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = gold.join(best, ["query_id", "doc_id"])
    ks = cutoffs(at)
    per = size.join(found.groupBy("query_id").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks]), "query_id", "left")
    rows = F.array(*[F.struct(F.lit(k).alias("cutoff"), (F.coalesce(f"h{k}", F.lit(0)) / F.col("n")).alias("r"), (F.coalesce(f"h{k}", F.lit(0)) > 0).cast("double").alias("any")) for k in ks])
    return per.select(F.explode(rows).alias("x")).groupBy("x.cutoff").agg(F.avg("x.r").alias("recall"), F.avg("x.any").alias("any_hit"), F.count(F.lit(1)).alias("n_queries"))


def misses(candidates: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Queries none of whose relevant documents is among the first ``k`` candidates."""
    gold = relevant.select("query_id", "doc_id").dropna().distinct()
    hit = gold.join(candidates.filter(F.col("rank") <= k).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return gold.select("query_id").distinct().join(hit.select("query_id").distinct(), "query_id", "left_anti")


def ceilings(candidates: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """The best recall that ``k`` answers allow at all, and with the given candidates."""
    gold = relevant.select("query_id", "doc_id").dropna().distinct()
    pool = candidates.select("query_id", "doc_id").distinct().withColumn("in_pool", F.lit(1))
    g = gold.join(pool, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("in_pool", F.lit(0))).alias("p"))
    return g.agg(F.avg(F.least("n", F.lit(k)) / F.col("n")).alias("ceiling"), F.avg(F.least("p", F.lit(k)) / F.col("n")).alias("oracle"), F.count(F.lit(1)).alias("n_queries"))


def promoted(candidate: dict[str, float], baseline: dict[str, float], max_drop: float = 0.02) -> tuple[bool, str]:
    """Whether a result replaces another: candidate recall and, where both have it, document-disjoint recall must hold, then recall decides, then precision."""
    drop = baseline.get("candidate_recall@150", 1.0) - candidate.get("candidate_recall@150", 1.0)
    if drop > max_drop:
        return False, f"candidate recall fell by {drop:.4f}"
    if "disjoint_recall@5" in baseline and "disjoint_recall@5" in candidate and baseline["disjoint_recall@5"] - candidate["disjoint_recall@5"] > max_drop:
        return False, f"document-disjoint recall fell by {baseline['disjoint_recall@5'] - candidate['disjoint_recall@5']:.4f}"
    for name in ("recall@5", "precision@5"):
        a, b = candidate.get(name, 0.0), baseline.get(name, 0.0)
        if a != b:
            return a > b, f"{name} {a:.4f} against {b:.4f}"
    return False, "no measure changed"


def same_scores(a: DataFrame, b: DataFrame, keys: list[str], score: str, atol: float = 1e-2, rtol: float = 1e-2) -> DataFrame:
    """Rows of ``b`` whose score differs from that of ``a`` beyond the tolerance, or that stand on one side only."""
    j = a.select(*keys, F.col(score).alias("x")).join(b.select(*keys, F.col(score).alias("y")), keys, "full")
    return j.filter(F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > atol + rtol * F.abs("y")))


def same_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries whose ``answer`` lists differ or exist on one side only."""
    j = a.select("query_id", F.col("answer").alias("x")).join(b.select("query_id", F.col("answer").alias("y")), "query_id", "full")
    return j.filter(~F.equal_null("x", "y")).select("query_id")


def acceptance(answers: DataFrame, expected: DataFrame, corpus: DataFrame, relevant: DataFrame, least: dict[str, float]) -> DataFrame:
    """One row recomputed from stored answers: coverage, errors, recall and precision, and the verdict.

    ``PASS`` needs no error and every measure of ``least`` reached.
    """
    have = expected.select("query_id").distinct().join(answers.select("query_id").distinct().withColumn("_a", F.lit(1)), "query_id", "left")
    covered = have.agg(F.count(F.lit(1)).alias("n_expected"), F.count("_a").alias("n_answered"))
    wrong = answer_errors(answers, expected, corpus).agg(F.count(F.lit(1)).alias("n_errors"))
    score = means(per_query(answers, relevant)).select(*[F.round(c, 6).alias(c) for c in ("recall", "precision")])
    good = reduce(lambda a, b: a & b, [F.coalesce(F.col(k), F.lit(0.0)) >= v for k, v in least.items()], F.col("n_errors") == 0)
    return covered.crossJoin(wrong).crossJoin(score).withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))  # single rows


# Validation ----------------------------------------------------------------

#: Columns of the canonical tables.
DOCUMENTS = ("doc_id", "name_raw", "title", "link", "passage_raw", "passage_norm", "legal_number", "year", "doc_type", "is_empty")
CHUNKS = ("chunk_id", "doc_id", "granularity", "chapter", "section", "article", "clause", "point", "text_raw", "text_norm", "parent_chunk_id", "token_count", "is_empty")
#: Other names under which a column may come.
ALIASES = {"document_id": "doc_id", "chunk_level": "granularity", "chunk_type": "granularity", "text": "text_raw", "document_text": "passage_norm", "question": "question_raw", "num_gold": "gold_count", "qid": "query_id"}


def renamed(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """``df`` with aliases of wanted columns renamed, ids as strings, other columns kept."""
    have = {c.lower(): c for c in df.columns}
    out = df
    for alias, name in ALIASES.items():
        if name in wanted and name not in have and alias in have:
            out = out.withColumnRenamed(have[alias], name)
            have[name] = name
    for c in out.columns:
        if c.endswith("_id") or c == "year":
            out = out.withColumn(c, F.col(c).cast("string"))
    return out


def missing_columns(df: DataFrame, wanted: tuple[str, ...]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def violations(docs: DataFrame, chunks: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """``check_name, n`` of a canonical dataset; all 0 for a sound one.

    ``qrels`` has ``query_id, doc_id, relevance``.  Counts are of distinct ids,
    or of rows for repeated keys.
    """
    d, q = docs.select("doc_id").distinct(), queries.select("query_id").distinct()
    macro = chunks.filter("granularity = 'macro'").select(F.col("chunk_id").alias("parent_chunk_id"), F.col("doc_id").alias("parent_doc"), F.lit(True).alias("known")).distinct()
    micro = chunks.filter("granularity = 'micro' and parent_chunk_id is not null").select("chunk_id", "doc_id", "parent_chunk_id")
    parent = micro.join(macro, "parent_chunk_id", "left")
    gold = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    repeated = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = {
        "repeated document": repeated(docs, "doc_id"), "repeated chunk": repeated(chunks, "chunk_id"), "unknown granularity": chunks.filter("granularity is null or granularity not in ('macro', 'micro')"),
        "chunk of unknown document": chunks.filter("doc_id is not null").select("doc_id").distinct().join(d, "doc_id", "left_anti"),
        "document without chunks": docs.filter("not is_empty").select("doc_id").distinct().join(chunks.select("doc_id").distinct(), "doc_id", "left_anti"),
        "missing parent": parent.filter("known is null").select("parent_chunk_id").distinct(), "parent in another document": parent.filter("parent_doc != doc_id"),
        "repeated query": repeated(queries, "query_id"), "repeated judgement": repeated(qrels, "query_id", "doc_id"), "judgement of unknown query": qrels.select("query_id").distinct().join(q, "query_id", "left_anti"),
        "judgement of unknown document": qrels.select("doc_id").distinct().join(d, "doc_id", "left_anti"), "relevance other than 1": qrels.filter("relevance is null or relevance != 1"),
        "wrong gold count": queries.join(gold, "query_id", "left").filter("gold_count is not null").filter(F.col("gold_count") != F.coalesce("n_gold", F.lit(0))),
    }
    one = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("check_name"), "n") for k, df in rows.items()]
    return reduce(DataFrame.unionByName, one)


#: Columns of questions and judgements.
QUERIES, JUDGEMENTS = ("query_id", "question_raw", "question_norm", "gold_count"), ("query_id", "doc_id", "relevance")


def validated(docs: DataFrame, chunks: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """``check_name, n`` of tables whose columns may come under other names: missing columns, or else all checks of ``violations``."""
    given = {"documents": (docs, DOCUMENTS), "chunks": (chunks, CHUNKS), "queries": (queries, QUERIES), "judgements": (qrels, JUDGEMENTS)}
    tables = {k: renamed(df, want) for k, (df, want) in given.items()}
    lost = [(f"missing column {k}.{c}", 1) for k, (_, want) in given.items() for c in missing_columns(tables[k], want)]
    if lost:
        return docs.sparkSession.createDataFrame(lost, "check_name string, n long")
    return violations(*tables.values())


def answer_errors(answers: DataFrame, expected: DataFrame | None = None, corpus: DataFrame | None = None, exact: int | None = None) -> DataFrame:
    """``query_id, error`` of answers: length, nulls, repeats, unknown documents, missing and extra queries."""
    n = F.size("answer")
    length = n != exact if exact is not None else ~n.between(1, 5)
    tests = {"no list": F.col("answer").isNull(), "wrong length": F.col("answer").isNotNull() & length, "null document": F.exists("answer", lambda x: x.isNull()), "repeated document": F.size(F.array_distinct("answer")) < n}
    found = answers.select("query_id", F.explode(F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())).alias("error"))
    if corpus is not None:
        each = answers.select("query_id", F.explode("answer").alias("doc_id")).filter("doc_id is not null")
        unknown = each.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").select("query_id").distinct()
        found = found.union(unknown.select("query_id", F.lit("unknown document")))
    if expected is not None:
        ids = expected.select("query_id").distinct()
        found = found.union(ids.join(answers, "query_id", "left_anti").select("query_id", F.lit("missing query"))).union(answers.join(ids, "query_id", "left_anti").select("query_id", F.lit("extra query")))
    return found


def cardinalities(docs: DataFrame, chunks: DataFrame, queries: DataFrame, qrels: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """``name, n`` of the tables' parts, with ``expected`` and ``ok`` where given."""
    parts = {"documents": docs, "empty documents": docs.filter("is_empty"), "chunks": chunks, "macro chunks": chunks.filter("granularity = 'macro'"), "micro chunks": chunks.filter("granularity = 'micro'"), "queries": queries, "judgements": qrels}
    out = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in parts.items()])
    if expected is None:
        return out
    want = out.sparkSession.createDataFrame(list(expected.items()), "name string, expected long")
    return out.join(want, "name", "full").withColumn("ok", F.equal_null("n", "expected"))


def parent_documents(chunks: DataFrame) -> DataFrame:
    """Micro chunks with the document of their macro chunk and whether it is their own."""
    macro = chunks.filter("granularity = 'macro'").select(F.col("chunk_id").alias("parent_chunk_id"), F.col("doc_id").alias("parent_doc")).dropDuplicates(["parent_chunk_id"])
    micro = chunks.filter("granularity = 'micro'").select("chunk_id", "doc_id", "parent_chunk_id")
    return salted_join(micro, macro, ["parent_chunk_id"], ["chunk_id"], "left").select("chunk_id", "doc_id", "parent_chunk_id", "parent_doc", F.equal_null("doc_id", "parent_doc").alias("same"))
