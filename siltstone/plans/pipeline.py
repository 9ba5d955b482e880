"""The whole way from questions to answers, and its measure out of fold.

Branches are computed for all questions at once; only question memory, which
reads labels, depends on the fold: a fold's questions see the questions and
judgements of the other folds alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import evidence as E
from siltstone.operators import exact, lexical, memory, metrics, ranking, rerank
from siltstone.operators import learning as G
from siltstone.operators.splits import bucket_folds
from siltstone.sources import canonical as C
from siltstone.storage import cut, settled


@dataclass(frozen=True)
class Settings:
    """Depths and weights of the pipeline; the same in every path."""

    branch_depth: int = 100
    exact_depth: int = 10
    memory_depth: int = 10
    candidates: int = 50
    reranked: int = 10
    evidence_chunks: int = 2
    answers: int = 5
    memory_threshold: float = 0.5
    folds: int = 5
    weights: dict = field(default_factory=lambda: dict(ranking.BRANCH_WEIGHTS))

    def __post_init__(self) -> None:
        for name in ("branch_depth", "exact_depth", "memory_depth", "candidates", "reranked", "evidence_chunks", "folds"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if not 1 <= self.answers <= 5:
            raise ValueError("an answer has one to five documents")


def static_branches(questions: DataFrame, docs: DataFrame, chunks: DataFrame, c: Settings) -> DataFrame:
    """``query_id, branch, doc_id, rank, score, best_chunk_id`` of the branches that read no labels."""
    # The tokens of a document's fields are split once a document, not once a chunk.
    micro = settled(lexical.enriched(chunks.filter("granularity = 'micro'"), docs, {"legal": X.legal_tokens, "segmented": X.segmented_tokens}), "micro")
    one = lexical.search(micro, questions, "question", c.branch_depth, split="legal").withColumn("branch", F.lit("bm25"))
    two = lexical.search(micro, questions, "question", c.branch_depth, lexical.SEGMENTED_WEIGHTS, X.segmented_tokens, None, "segmented").withColumn("branch", F.lit("bm25_pyvi"))
    three = exact.match(questions, docs, chunks, c.exact_depth).withColumns({"branch": F.lit("exact"), "best_chunk_id": F.lit(None).cast("string")})
    cols = ["query_id", "branch", "doc_id", "rank", "score", "best_chunk_id"]
    return one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select(*cols))


def memory_branch(questions: DataFrame, train: DataFrame, relevant: DataFrame, c: Settings) -> DataFrame:
    """Votes of the training questions of a question's ``part`` (all are one part unless given)."""
    text = lambda df: memory.parted(df).select("part", "query_id", F.col("question").alias("text"))
    known = cut(text(train).join(relevant.select("query_id").distinct(), "query_id", "left_semi"), "known")
    if "part" in questions.columns or "part" in train.columns:
        pairs = memory.similar(text(questions), known, c.memory_threshold)
    else:  # one part is a fold that no training question is in
        held, rest = (df.select(F.lit(fold).alias("fold"), "query_id", "text") for fold, df in ((0, text(questions)), (1, known)))
        pairs = memory.across_folds(held, rest, 1, c.memory_threshold)
    return _voted(memory.votes(pairs, relevant, known.count(), c.memory_depth))


def _voted(v: DataFrame) -> DataFrame:
    return v.select("query_id", F.lit("memory").alias("branch"), "doc_id", "rank", "score", F.lit(None).cast("string").alias("best_chunk_id"))


def answered(ranks: DataFrame, questions: DataFrame, docs: DataFrame, chunks: DataFrame, c: Settings) -> tuple[DataFrame, DataFrame]:
    """Fused candidates with final rank, and the answers."""
    # Each step is written, so that no later plan holds all of them.
    ranks = settled(ranks, "ranks")
    fused = settled(ranking.fuse(ranks, c.weights, top_k=c.candidates), "fused")
    prior = ranks.filter("best_chunk_id is not null").groupBy("query_id", "doc_id").agg(F.min_by("best_chunk_id", "branch").alias("prior_chunk_id"))
    head = fused.filter(F.col("rank") <= c.reranked).select("query_id", "doc_id").join(prior, ["query_id", "doc_id"], "left")
    head = settled(head, "head")
    macro = settled(chunks.filter("granularity = 'macro'").join(head.select("doc_id").distinct(), "doc_id", "left_semi"), "macro")
    chosen = E.selected(E.scored_chunks(head, questions, macro), c.evidence_chunks)
    rec = E.records(E.packs(chosen, docs), docs).join(questions, "query_id")
    pairs = rec.select("query_id", "doc_id", "chunk_id", rerank.shared_words(F.col("question"), F.when(F.col("n") == 1, F.col("pack")).otherwise(F.col("reranker_text"))).alias("pair_score"))
    scored = rerank.reranked(fused, rerank.by_document(pairs), c.reranked)
    # The word count is brought to the scale of a logit.
    final = ranking.final_rrf(scored.drop("rank").withColumn("reranker_score", F.when(F.col("reranker_score") > -900, F.col("reranker_score") / 10).otherwise(F.col("reranker_score"))), weights=c.weights)
    final = settled(final, "final")
    best = rerank.answers(final.withColumn("rank", F.col("final_rank")), c.answers, valid=docs.select("doc_id"))
    return final, best


def predict(questions: DataFrame, train: DataFrame, relevant: DataFrame, docs: DataFrame, chunks: DataFrame, c: Settings = Settings()) -> DataFrame:
    """``query_id, answer`` for ``query_id, question``; the memory holds the training questions but never the one that asks."""
    ranks = static_branches(questions, docs, chunks, c).unionByName(memory_branch(questions, train, relevant, c))
    return answered(ranks, questions, docs, chunks, c)[1]


def fold_memory(questions: DataFrame, every: DataFrame, relevant: DataFrame, folds: DataFrame, c: Settings) -> DataFrame:
    """The memory branch of each question, from the questions of the other folds."""
    text = lambda df: df.join(folds, "query_id").select("fold", "query_id", F.col("question").alias("text"))
    known = cut(text(every.join(relevant.select("query_id").distinct(), "query_id", "left_semi")), "known")
    v = memory.votes(memory.across_folds(text(questions), known, c.folds, c.memory_threshold), relevant, known.count(), c.memory_depth)
    return _voted(v)


def fold_features(candidates: DataFrame, questions: DataFrame, relevant: DataFrame, folds: DataFrame) -> DataFrame:
    """Feature rows with fold and label of fused candidates; the document prior comes from the other folds."""
    c = candidates.join(questions.select("query_id", F.length(F.trim("question")).cast("double").alias("query_length")), "query_id", "left").join(folds, "query_id")
    return G.features(c, G.fold_prior(relevant, folds), relevant)


def out_of_fold_features(questions: DataFrame, every: DataFrame, relevant: DataFrame, docs: DataFrame, chunks: DataFrame, c: Settings = Settings()) -> DataFrame:
    """The out-of-fold feature table of the fused and reranked candidates of ``out_of_fold``."""
    folds = bucket_folds(every.select("query_id"), c.folds)
    ranks = static_branches(questions, docs, chunks, c).unionByName(fold_memory(questions, every, relevant, folds, c))
    return fold_features(answered(ranks, questions, docs, chunks, c)[0], questions, relevant, folds)


def out_of_fold(questions: DataFrame, every: DataFrame, relevant: DataFrame, docs: DataFrame, chunks: DataFrame, c: Settings = Settings()) -> DataFrame:
    """``query_id, fold, answer`` with the memory of each fold built from the others."""
    folds = bucket_folds(every.select("query_id"), c.folds)
    ranks = static_branches(questions, docs, chunks, c).unionByName(fold_memory(questions, every, relevant, folds, c))
    return answered(ranks, questions, docs, chunks, c)[1].join(folds, "query_id").select("query_id", "fold", "answer")


def _all(s, d):
    q = C.questions(s, d).select("query_id", F.col("question_raw").alias("question"))
    # The last rows of the tables are found once, whatever reads them.
    docs = settled(C.docs(s, d).select("doc_id", "title", "name_raw", "link", "legal_number", "year", "doc_type"), "documents")
    chunks = settled(C.chunks(s, d).select("chunk_id", "doc_id", "granularity", "article", "clause", "point", "text_raw", "text_norm"), "chunks")
    q = settled(q, "questions")
    return C.search_set(q), q, settled(C.relevant(s, d), "relevant"), docs, chunks


def z01_predict(s, d):
    return predict(*_all(s, d)).select("query_id", F.array_join("answer", ",").alias("answer"))


def z02_out_of_fold(s, d):
    some, every, rel, docs, chunks = _all(s, d)
    got = out_of_fold(some, every, rel, docs, chunks)
    m = metrics.per_query(got.select("query_id", "answer"), rel.join(some.select("query_id"), "query_id", "left_semi"))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg_at_5")])


QUERIES = {"z01_predict": z01_predict, "z02_out_of_fold": z02_out_of_fold}
SQL: dict[str, str] = {}
