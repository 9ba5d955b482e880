"""Reranking of candidates by pair scores, and the choice of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.ranking import best, steady

UNSCORED = -999.0


def shared_words(a: Column, b: Column) -> Column:
    """Number of distinct lower-case words that two texts share: the scorer that needs no model."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(X.text(c)), X.WS + "+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))).cast("double")


def scored_by(pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]], question: str = "question", passage: str = "passage") -> DataFrame:
    """``pairs`` with ``pair_score`` from a function over batches of texts, shortest first within a batch."""
    at = pairs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, p = (b.column(at.index(c)).to_pylist() for c in (question, passage))
            order = sorted(range(len(q)), key=lambda i: len(p[i] or ""))
            got = [0.0] * len(q)
            for i, s in zip(order, score([q[i] for i in order], [p[i] for i in order]), strict=True):
                got[i] = float(s)
            yield b.append_column("pair_score", pa.array(got))

    from pyspark.sql import types as T

    return pairs.mapInArrow(work, T.StructType([*pairs.schema.fields, T.StructField("pair_score", T.DoubleType())]))


def ensemble(members: DataFrame, keys: list[str], n_members: int) -> DataFrame:
    """Mean score of at least two members; a pair that lacks a member's score is an error row with null."""
    if n_members < 2:
        raise ValueError("an ensemble needs two members at least")
    g = members.groupBy(*keys).agg(F.avg("pair_score").alias("m"), F.count_distinct("member").alias("n"))
    return g.select(*keys, F.when(F.col("n") == n_members, F.col("m")).alias("pair_score"))


def by_document(scored: DataFrame) -> DataFrame:
    """Best, second (the best again if single), margin, best chunk and number of chunks of ``query_id, doc_id, chunk_id, pair_score``."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("pair_score")).alias("s"), F.col("chunk_id").alias("c"))))
    g = scored.groupBy("query_id", "doc_id").agg(items.alias("i"))
    top = -F.get("i", F.lit(0))["s"]
    second = F.coalesce(-F.get("i", F.lit(1))["s"], top)
    return g.select("query_id", "doc_id", top.alias("reranker_score"), second.alias("reranker_second_score"), (top - second).alias("reranker_margin"), F.get("i", F.lit(0))["c"].alias("reranker_best_chunk_id"), F.size("i").alias("evidence_chunk_count"))


def reranked(candidates: DataFrame, documents: DataFrame, top_k: int) -> DataFrame:
    """The first ``top_k`` candidates by ``rank`` in order of reranker score, the others after them unscored.

    A candidate among the first without evidence has score 0.
    """
    head = F.col("rank") <= top_k
    r = candidates.join(documents, ["query_id", "doc_id"], "left")
    score = F.when(head, F.coalesce("reranker_score", F.lit(0.0))).otherwise(UNSCORED)
    second = F.when(head, F.coalesce("reranker_second_score", F.lit(0.0))).otherwise(UNSCORED)
    margin = F.when(head, F.coalesce("reranker_margin", F.lit(0.0))).otherwise(0.0)
    n = F.when(head, F.coalesce("evidence_chunk_count", F.lit(0))).otherwise(0)
    r = r.withColumns({"reranker_score": score, "reranker_second_score": second, "reranker_margin": margin, "evidence_chunk_count": n, "reranker_best_chunk_id": F.when(head, F.col("reranker_best_chunk_id"))})
    return best(r, ["query_id"], [F.desc(head), F.when(head, -steady("reranker_score")), F.when(~head, F.col("rank")), F.asc("doc_id")], 2**31 - 1, "rerank_rank")


def reranked_packs(candidates: DataFrame, packed: DataFrame, questions: DataFrame, top_k: int, score: Callable[[Column, Column], Column] | None) -> DataFrame:
    """Candidates with each of the first ``top_k`` documents scored by question and pack; without a scorer they keep their order unscored."""
    if score is None:
        return best(candidates.withColumn("reranker_score", F.lit(UNSCORED)), ["query_id"], [F.asc("rank"), F.asc("doc_id")], 2**31 - 1, "rerank_rank")
    p = packed.join(questions.select("query_id", "question"), "query_id").select("query_id", "doc_id", F.concat("doc_id", F.lit("_pack")).alias("chunk_id"), score(F.col("question"), F.col("pack")).alias("pair_score"))
    return reranked(candidates, by_document(p), top_k)


def rerank_texts(candidates: DataFrame, question: str, passage: str, top_k: int, score=shared_words) -> DataFrame:
    """Candidates by the score of the question with the first 1,000 characters of their text; ``final_rank`` from 1."""
    r = candidates.withColumn("reranker_score", score(F.col(question), F.left(X.text(F.col(passage)), F.lit(1000))))
    return best(r, ["query_id"], [F.desc("reranker_score"), F.asc("doc_id")], top_k, "final_rank")


def answers(ranked: DataFrame, k: int = 5, fill: int | None = None, fallback: list[str] = (), valid: DataFrame | None = None) -> DataFrame:
    """``query_id, answer``: the first ``k`` distinct valid documents by ``rank``.

    Fewer than ``fill`` documents (1 unless given) are filled up from ``fallback``
    where valid, then from the smallest valid ids; a query without any valid
    candidate is filled too.  ``k`` and ``fill`` lie between 1 and 5.
    """
    if not 1 <= k <= 5 or not 1 <= (fill or 1) <= k:
        raise ValueError("an answer has one to five documents")
    ids = ranked.select("query_id").distinct()
    r = ranked.filter(F.trim("doc_id") != "")
    extra = list(fallback)
    if valid is not None:
        known = valid.select("doc_id").distinct()
        r = r.join(known, "doc_id", "left_semi")
        # At most k + fallback ids reach the driver.
        real = {x[0] for x in known.filter(F.col("doc_id").isin(extra)).collect()} if extra else set()
        extra = [x for x in extra if x in real] + [x[0] for x in known.orderBy("doc_id").limit(2 * k).collect()]
    one = r.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    top = best(one, ["query_id"], [F.asc("rank"), F.asc("doc_id")], k, "place")
    got = ids.join(top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("t")), "query_id", "left")
    chosen = F.coalesce(F.transform("t", lambda x: x["doc_id"]), F.array().cast("array<string>"))
    more = F.array(*[F.lit(x) for x in extra]).cast("array<string>")
    need = F.greatest(F.size(chosen), F.lit(fill or 1))
    return got.select("query_id", F.slice(F.array_distinct(F.concat(chosen, more)), F.lit(1), need).alias("answer"))


#: Names under which the columns of a candidate table may come.
NAMES = {"query_id": ("query_id", "qid"), "question": ("question", "query_text", "query", "question_raw"), "doc_id": ("doc_id", "document_id"), "chunk_id": ("chunk_id", "best_chunk_id"), "passage": ("passage", "evidence_text", "text", "text_norm", "text_raw")}


def evaluated_table(table: DataFrame, relevant: DataFrame, score=shared_words, policy: str = "max", k: int = 5) -> tuple[str, DataFrame | list[str]]:
    """Score a candidate table of any of the known column names, bring chunks to documents and measure.

    ``("PASS", measures)``, or ``("BLOCKED", missing columns)``.
    """
    from siltstone.operators.metrics import ranking_measures
    from siltstone.operators.ranking import chunks_to_documents

    at = {want: next((n for n in names if n in table.columns), None) for want, names in NAMES.items()}
    missing = [w for w, n in at.items() if n is None and w != "chunk_id"]
    if missing:
        return "BLOCKED", missing
    rows = table.select(F.col(at["query_id"]).cast("string").alias("query_id"), F.col(at["doc_id"]).cast("string").alias("doc_id"), F.col(at["chunk_id"] or at["doc_id"]).cast("string").alias("chunk_id"), score(F.col(at["question"]), F.col(at["passage"])).alias("score"))
    one = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    ranked = chunks_to_documents(one, rows.select("chunk_id", "doc_id").distinct(), policy)
    return "PASS", ranking_measures(ranked, relevant, k)
