"""Ranks and best rows within groups, and the fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the retrieval branches in candidate fusion.
BRANCH_WEIGHTS = {"bm25": 1.0, "bm25_pyvi": 1.0, "dense": 1.2, "memory": 2.0, "exact": 2.5}
RRF_K = 60


def steady(score: str | Column) -> Column:
    """A score rounded so that noise in the last place does not reorder rows."""
    return F.round(score, 9)


def best(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group with their rank from 1.

    Spark limits every group to ``k`` rows a task before the shuffle, so a
    group with a large share of all rows reaches its task as few rows.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= k)


def branch_ranks(candidates: DataFrame, depth: int, groups: tuple[str, ...] = ("query_id", "branch")) -> DataFrame:
    """Rank of each document in its branch by its highest finite score; ``depth`` documents a branch.

    Rows without query, branch, document or finite score do not count.
    """
    s = F.col("score").cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    one = candidates.filter(ok).dropna(subset=[*groups, "doc_id"]).groupBy(*groups, "doc_id").agg(F.max(s).alias("score"))
    return best(one, list(groups), [F.desc("score"), F.asc("doc_id")], depth)


def weight_of(branch: str | Column, weights: dict[str, float], default: float | None = None) -> Column:
    b = F.col(branch) if isinstance(branch, str) else branch
    out = F.lit(default).cast("double")
    for name, w in weights.items():
        out = F.when(b == name, F.lit(float(w))).otherwise(out)
    return out


def weighted_rrf(ranks: DataFrame, weights: dict[str, float], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of weighted reciprocal ranks; branches without a weight are left out."""
    r = ranks.withColumn("_w", weight_of("branch", weights)).filter("_w is not null")
    one = r.groupBy("query_id", "doc_id").agg(F.sum(F.col("_w") / (k + F.col("rank"))).alias("score"))
    return best(one, ["query_id"], [F.desc(steady("score")), F.asc("doc_id")], limit or 2**31 - 1)


def fuse(ranks: DataFrame, weights: dict[str, float] = BRANCH_WEIGHTS, k: int = RRF_K, top_k: int = 100) -> DataFrame:
    """Candidate union: fused score, number of sources, and rank and score by branch.

    A branch that ``weights`` does not name counts with weight 1.
    """
    part = F.col("_w") / (k + F.col("rank"))
    r = ranks.withColumn("_w", weight_of("branch", weights, 1.0))
    wide = [x for b in weights for x in (F.min(F.when(F.col("branch") == b, F.col("rank"))).alias(f"{b}_rank"), F.max(F.when(F.col("branch") == b, F.col("score"))).alias(f"{b}_score"))]
    one = r.groupBy("query_id", "doc_id").agg(F.sum(part).alias("rrf_score"), F.count_distinct("branch").alias("source_count"), *wide)
    return best(one, ["query_id"], [F.desc(steady("rrf_score")), F.asc("doc_id")], top_k)


def fuse_runs(runs: DataFrame, weights: list[float] | None = None, n_runs: int | None = None, k: int = RRF_K) -> DataFrame:
    """Classic fusion of ``run, query_id, position, doc_id``: first place of a document in a run counts, the first run's row is kept.

    Without weights every run has an equal share of one.
    """
    n = n_runs or (len(weights) if weights else 1)
    first = runs.dropna(subset=["doc_id"]).filter("doc_id != ''").groupBy("query_id", "run", "doc_id").agg(F.min("position").alias("position"))
    w = F.lit(1.0 / n) if weights is None else F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("run")), F.lit(1.0))
    one = first.groupBy("query_id", "doc_id").agg(F.sum(w / (k + F.col("position"))).alias("rrf_score"), F.min("run").alias("first_run"))
    return best(one, ["query_id"], [F.desc(steady("rrf_score")), F.asc("doc_id")], 2**31 - 1)


def roll_up(scored: DataFrame, keys: tuple[str, str] = ("query_id", "doc_id"), chunk: str = "chunk_id", score: str = "score", second_share: float = 0.1) -> DataFrame:
    """Documents from chunk scores: best plus a tenth of the second, and best, second, mean and best chunk.

    A single chunk has second score 0.  Groups are as small as the cut-off that
    the chunks passed before.
    """
    items = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(chunk).alias("c"))))
    g = scored.groupBy(*keys).agg(items.alias("i"), F.avg(score).alias("mean_score"))
    top, second = -F.get("i", F.lit(0))["s"], F.coalesce(-F.get("i", F.lit(1))["s"], F.lit(0.0))
    return g.select(*keys, (top + second_share * second).alias("score"), top.alias("best_score"), second.alias("second_score"), "mean_score", F.get("i", F.lit(0))["c"].alias("best_chunk_id"))


def chunks_to_documents(scored: DataFrame, mapping: DataFrame, policy: str = "max", limit: int | None = None) -> DataFrame:
    """Best or mean chunk score of each document; chunks without a document are dropped."""
    if policy not in ("max", "mean"):
        raise ValueError(f"unknown aggregation policy: {policy}")
    f = F.max if policy == "max" else F.avg
    one = scored.join(mapping, "chunk_id").groupBy("query_id", "doc_id").agg(f("score").alias("score"))
    return best(one, ["query_id"], [F.desc(steady("score")), F.asc("doc_id")], limit or 2**31 - 1)


def final_rrf(c: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None, rerank_weight: float = 2.5) -> DataFrame:
    """Final score of fused candidates: reciprocal ranks below 900, exact and reranker scores at a twentieth.

    Reads ``bm25_rank, bm25_pyvi_rank, dense_rank, memory_rank, exact_score,
    reranker_score, rrf_score``; a score of 0 falls back to ``rrf_score``.
    """
    from siltstone.functions.text import sigmoid

    w = BRANCH_WEIGHTS | (weights or {})
    score = F.lit(0.0)
    for b in ("bm25", "bm25_pyvi", "memory", "dense"):
        r = F.col(f"{b}_rank").cast("double")
        score = score + F.when(r < 900, w[b] / (k + r)).otherwise(0.0)
    exact, rerank = F.col("exact_score").cast("double"), F.col("reranker_score").cast("double")
    score = score + F.when(exact > 0, w["exact"] * 0.05 * exact).otherwise(0.0)
    score = score + F.when(rerank > -900, rerank_weight * 0.05 * sigmoid(rerank)).otherwise(0.0)
    out = c.withColumn("final_score", F.when(score == 0, F.coalesce("rrf_score", F.lit(0.0))).otherwise(score))
    return best(out, ["query_id"], [F.desc(steady("final_score")), F.asc("doc_id")], 2**31 - 1, "final_rank")
