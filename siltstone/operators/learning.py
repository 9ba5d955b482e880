"""Ranking features, a ridge ranker, and its cross-fitted comparison with fixed fusion."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import safe_number
from siltstone.operators.ranking import best, final_rrf, steady
from siltstone.sources.stores import read_bytes, write_bytes
from siltstone.storage import settled

ABSENT_RANK, UNSCORED = 999.0, -999.0
#: Names of the features, the core ones and the auxiliary ones.
CORE = [
    "raw_bm25_rank", "raw_bm25_score", "pyvi_bm25_rank", "pyvi_bm25_score", "dense_rank", "dense_score", "dense_second_score", "dense_margin", "memory_rank", "memory_similarity", "memory_vote_count",
    "exact_score", "exact_legal_number", "exact_article", "exact_clause", "exact_point", "exact_year", "exact_doc_type", "exact_title_overlap", "source_count", "rrf_score", "reranker_score",
    "reranker_second_score", "reranker_margin", "query_length", "train_doc_freq",
]
AUXILIARY = [
    "bm25_score", "bm25_rank", "bm25_inv_rank", "bm25_best_score", "bm25_second_score", "bm25_mean_score", "exact_match_score", "exact_title", "memory_score", "memory_inv_rank",
    "memory_lexical_similarity", "memory_dense_similarity", "dense_inv_rank", "dense_best_score", "reranker_best_score", "evidence_chunk_count",
]


def document_prior(relevant: DataFrame) -> DataFrame:
    """``doc_id, train_doc_freq``: queries that a document is relevant for, as a share of all queries with relevant documents."""
    r = relevant.select("query_id", "doc_id").dropna().distinct()
    n = r.select("query_id").distinct().count()
    return r.groupBy("doc_id").agg((F.count(F.lit(1)) / max(n, 1)).alias("train_doc_freq"))


def fold_prior(relevant: DataFrame, folds: DataFrame) -> DataFrame:
    """``fold, doc_id, train_doc_freq`` from the judgements of the other folds: totals minus the fold's own counts.

    Judgements of queries without a fold train no fold.
    """
    r = settled(relevant.select("query_id", "doc_id").dropna().distinct().join(folds.select("query_id", "fold").distinct(), "query_id"), "judgements")
    own = r.groupBy("fold", "doc_id").agg(F.count(F.lit(1)).alias("own"))
    sizes = folds.select("fold").distinct().join(r.groupBy("fold").agg(F.count_distinct("query_id").alias("held")), "fold", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    n = F.broadcast(sizes.crossJoin(F.broadcast(sizes.agg(F.sum("held").alias("n")))))  # one row a fold
    every = own.groupBy("doc_id").agg(F.sum("own").alias("total")).crossJoin(n).join(own, ["fold", "doc_id"], "left")
    rest = F.col("total") - F.coalesce("own", F.lit(0))
    return every.select("fold", "doc_id", (rest / F.greatest(F.col("n") - F.col("held"), F.lit(1))).alias("train_doc_freq"))


#: The names under which a feature may come, in the order in which they are tried.
def features(candidates: DataFrame, prior: DataFrame | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """The 42 features and the label of candidate rows.

    A ``prior`` with a fold joins the rows of that fold.  Missing columns and values that are no finite number take their defaults:
    rank 999, reranker -999, source count 1, else 0.
    """
    have = set(candidates.columns)

    def first(*names: str) -> Column | None:
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else None

    def num(*names: str, default: float = 0.0, otherwise: Column | None = None) -> Column:
        c = first(*names)
        if c is None:
            return otherwise if otherwise is not None else F.lit(default)
        return F.when(c.isNull(), otherwise).otherwise(safe_number(c, default)) if otherwise is not None else safe_number(c, default)

    def flag(name: str) -> Column:
        return F.when(F.col(name).cast("boolean"), 1.0).otherwise(0.0) if name in have else F.lit(0.0)

    def inverse(rank: Column) -> Column:
        return F.when(rank < 900, 1 / (60 + rank)).otherwise(0.0)

    bm25, pyvi, dense, memory = (num(*n, default=ABSENT_RANK) for n in (("raw_bm25_rank", "bm25_rank"), ("pyvi_bm25_rank", "bm25_pyvi_rank"), ("dense_rank",), ("memory_rank",)))
    raw = num("raw_bm25_score", "bm25_raw_score", "bm25_score")
    d1, d2 = num("dense_score", "dense_best_score"), num("dense_second_score")
    similar = num("memory_similarity", "memory_dense_similarity", "memory_lexical_similarity", "memory_score")
    r1, r2 = num("reranker_score", "reranker_best_score", default=UNSCORED), num("reranker_second_score", default=UNSCORED)
    exact = num("exact_score", "exact_match_score")
    f = {
        "raw_bm25_rank": bm25, "raw_bm25_score": raw, "pyvi_bm25_rank": pyvi, "pyvi_bm25_score": num("pyvi_bm25_score", "bm25_pyvi_score", "bm25_pyvi_best_score"),
        "dense_rank": dense, "dense_score": d1, "dense_second_score": d2, "dense_margin": num("dense_margin", otherwise=d1 - d2), "memory_rank": memory, "memory_similarity": similar,
        "memory_vote_count": num("memory_vote_count"), "exact_score": exact, **{k: flag(k) for k in ("exact_legal_number", "exact_article", "exact_clause", "exact_point", "exact_year", "exact_doc_type")},
        "exact_title_overlap": num("exact_title_overlap", otherwise=flag("exact_title")), "source_count": num("source_count", default=1.0), "rrf_score": num("rrf_score"), "reranker_score": r1,
        "reranker_second_score": r2, "reranker_margin": num("reranker_margin", otherwise=F.when((r1 > -900) & (r2 > -900), r1 - r2).otherwise(0.0)), "query_length": num("query_length"),
        "bm25_score": raw, "bm25_rank": bm25, "bm25_inv_rank": inverse(bm25), "bm25_best_score": num("bm25_best_score", otherwise=raw), "bm25_second_score": num("bm25_second_score"),
        "bm25_mean_score": num("bm25_mean_score", otherwise=raw), "exact_match_score": exact, "exact_title": flag("exact_title"), "memory_score": num("memory_score", otherwise=similar),
        "memory_inv_rank": inverse(memory), "memory_lexical_similarity": num("memory_lexical_similarity", otherwise=similar), "memory_dense_similarity": num("memory_dense_similarity", otherwise=similar),
        "dense_inv_rank": inverse(dense), "dense_best_score": num("dense_best_score", otherwise=d1), "reranker_best_score": num("reranker_best_score", otherwise=r1), "evidence_chunk_count": num("evidence_chunk_count"),
    }
    keep = [c for c in ("fold",) if c in have]
    out = candidates.select("query_id", "doc_id", *keep, *[c.cast("double").alias(k) for k, c in f.items()], *([] if prior is not None or "train_doc_freq" not in have else [num("train_doc_freq").alias("train_doc_freq")]))
    if prior is not None:
        out = out.join(prior, ["doc_id", *[c for c in ("fold",) if c in prior.columns]], "left").withColumn("train_doc_freq", F.coalesce("train_doc_freq", F.lit(0.0)))
    elif "train_doc_freq" not in have:
        out = out.withColumn("train_doc_freq", F.lit(0.0))
    if relevant is not None:
        out = out.join(relevant.select("query_id", "doc_id", F.lit(1).alias("label")).distinct(), ["query_id", "doc_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    elif "label" not in out.columns:
        out = out.withColumn("label", F.lit(0))
    return out.select("query_id", "doc_id", *keep, *CORE, *AUXILIARY, "label")


class Ridge:
    """Linear regression with an L2 penalty on the coefficients, not on the intercept.

    Fitted from sums of products, one row of aggregates whatever the number of
    rows; only a matrix as wide as the features reaches the driver.
    """

    def __init__(self, columns: list[str], alpha: float = 1.0):
        self.columns, self.alpha, self.coefficients, self.intercept = list(columns), float(alpha), None, 0.0

    def moments(self, df: DataFrame, label: str = "label", by: list[str] = ()) -> DataFrame:
        """Sums of all products of the columns, the label and 1, by group."""
        z = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*self.columns, label]] + [F.lit(1.0)]
        return df.groupBy(*by).agg(*[F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i in range(len(z)) for j in range(i + 1)])

    def solve(self, m: np.ndarray) -> Ridge:
        """From the matrix of sums."""
        k, n = len(self.columns), m[-1, -1]
        if n == 0:
            self.coefficients = np.zeros(k)
            return self
        mean, y = m[:k, -1] / n, m[k, -1] / n
        self.coefficients = np.linalg.solve(m[:k, :k] - n * np.outer(mean, mean) + self.alpha * np.eye(k), m[:k, k] - n * mean * y)
        self.intercept = float(y - mean @ self.coefficients)
        return self

    @staticmethod
    def matrix(row, k: int) -> np.ndarray:
        m = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
        return m

    def fit(self, df: DataFrame, label: str = "label") -> Ridge:
        return self.solve(self.matrix(self.moments(df, label).first(), len(self.columns) + 2))

    def score(self) -> Column:
        return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(w) for c, w in zip(self.columns, self.coefficients, strict=True)), F.lit(self.intercept))

    def rank(self, df: DataFrame) -> DataFrame:
        """``df`` with ``final_score`` and ``final_rank``."""
        return best(df.withColumn("final_score", self.score()), ["query_id"], [F.desc(steady("final_score")), F.asc("doc_id")], 2**31 - 1, "final_rank")

    def to_json(self) -> str:
        return json.dumps({"model_type": "linear_ridge", "feature_cols": self.columns, "alpha": self.alpha, "coef": [float(x) for x in self.coefficients], "intercept": self.intercept})

    @classmethod
    def from_json(cls, text: str) -> Ridge:
        d = json.loads(text)
        out = cls(d["feature_cols"], d["alpha"])
        out.coefficients, out.intercept = np.array(d["coef"], dtype=float), float(d["intercept"])
        return out


def cross_fitted(df: DataFrame, columns: list[str], alpha: float = 1.0) -> DataFrame:
    """``df`` with ``final_score`` of a model fitted on all other folds, and ``final_rank``.

    One aggregation gives the sums of every fold; a fold's model uses the sums
    of the others, so each row is read once however many folds there are.
    """
    base = Ridge(columns, alpha)
    rows = base.moments(df, by=["fold"]).collect()  # one row a fold
    if len(rows) < 2:
        raise ValueError("cross-fitting needs two folds at least")
    k = len(columns) + 2
    sums = {r["fold"]: Ridge.matrix(r, k) for r in rows}
    total = sum(sums.values())
    score = F.lit(None).cast("double")
    for fold, m in sums.items():
        score = F.when(F.col("fold") == fold, Ridge(columns, alpha).solve(total - m).score()).otherwise(score)
    return best(df.withColumn("final_score", score), ["query_id"], [F.desc(steady("final_score")), F.asc("doc_id")], 2**31 - 1, "final_rank")


def winner(learned: dict[str, float], fixed: dict[str, float]) -> str:
    """The better of two pooled results by recall, then precision; fixed fusion on a tie."""
    key = lambda m: (m["recall"], m["precision"])
    return "learned" if key(learned) > key(fixed) else "fixed"


def gated(df: DataFrame, columns: list[str], relevant: DataFrame, predeclared: bool = False, k: int = 5) -> tuple[str, DataFrame, dict[str, dict[str, float]]]:
    """The ranking that wins the selection gate, its rows, and the pooled measures of both.

    The learned ranking is cross-fitted, so every row is ranked by a model that
    has not seen its fold; both are measured on the answers of all folds
    together.  ``predeclared`` takes fixed fusion and fits nothing.
    """
    from siltstone.operators import metrics
    from siltstone.operators.rerank import answers

    ranked = {"fixed": rank_by_fixed(df)} | ({} if predeclared else {"learned": cross_fitted(df, columns)})
    asked = relevant.join(df.select("query_id").distinct(), "query_id", "left_semi")
    pooled = {}
    for name, rows in ranked.items():
        a = answers(rows.select("query_id", "doc_id", F.col("final_rank").alias("rank")), k)
        m = metrics.means(metrics.per_query(a, asked)).first()
        pooled[name] = {c: m[c] or 0.0 for c in ("recall", "precision")}
    chosen = "fixed" if predeclared else winner(pooled["learned"], pooled["fixed"])
    return chosen, ranked[chosen], pooled


def rank_by_fixed(df: DataFrame) -> DataFrame:
    """Final fusion on feature rows."""
    names = {"raw_bm25_rank": "bm25_rank", "pyvi_bm25_rank": "bm25_pyvi_rank"}
    slim = df.select("query_id", "doc_id", *[F.col(a).alias(b) for a, b in names.items()], "dense_rank", "memory_rank", "exact_score", "reranker_score", "rrf_score")
    return final_rrf(slim)


def losses(temperature: float = 1.0, margin: float = 1.0) -> dict[str, Column]:
    """Training losses as expressions over ``logit, label``, ``pos, neg`` and ``scores`` (the positive first)."""
    x, y = F.col("logit"), F.col("label")
    gap = (F.col("pos") - F.col("neg")) / temperature
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    s = F.transform("scores", lambda v: v / temperature)
    top = F.array_max(s)
    lse = top + F.ln(F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
    return {"bce": soft(x) - x * y, "pairwise_logistic": soft(-gap), "pairwise_margin": F.greatest(F.lit(0.0), margin - (F.col("pos") - F.col("neg"))), "listwise": lse - F.get(s, F.lit(0))}


class Boosted:
    """Gradient-boosted trees on single candidates, in place of a listwise ranker that Spark does not have.

    The result is an approximation of its own, not the listwise model's.
    Without rows to learn from it ranks by fixed fusion.
    """

    def __init__(self, columns: list[str], rounds: int = 20, depth: int = 5, seed: int = 42):
        self.columns, self.rounds, self.depth, self.seed, self.model = list(columns), rounds, depth, seed, None

    def _packed(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.columns, outputCol="_x", handleInvalid="error").transform(df.na.fill(0.0, self.columns))

    def fit(self, df: DataFrame, label: str = "label") -> Boosted:
        from pyspark.ml.regression import GBTRegressor

        if df.limit(1).count():
            self.model = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="final_score", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed).fit(self._packed(df))
        return self

    def rank(self, df: DataFrame) -> DataFrame:
        """``df`` with ``final_score`` and ``final_rank``."""
        if self.model is None:
            return df.join(rank_by_fixed(df).select("query_id", "doc_id", "final_score", "final_rank"), ["query_id", "doc_id"])
        scored = self.model.transform(self._packed(df)).drop("_x")
        return best(scored, ["query_id"], [F.desc(steady("final_score")), F.asc("doc_id")], 2**31 - 1, "final_rank")


def boosted_ranker(df: DataFrame, columns: list[str], label: str = "label", rounds: int = 20, depth: int = 5, seed: int = 42):
    """A function from feature rows to ranked rows by ``Boosted`` trees fitted on ``df``."""
    return Boosted(columns, rounds, depth, seed).fit(df, label).rank


def save_model(spark: SparkSession, model: Ridge | Boosted, path: str) -> None:
    """Store a fitted ranker of either kind in a folder."""
    if isinstance(model, Ridge):
        write_bytes(spark, f"{path}/model.json", model.to_json().encode())
        return
    if model.model is not None:
        model.model.write().overwrite().save(f"{path}/trees")
    form = {"model_type": "boosted_trees", "feature_cols": model.columns, "rounds": model.rounds, "depth": model.depth, "seed": model.seed, "fitted": model.model is not None}
    write_bytes(spark, f"{path}/model.json", json.dumps(form).encode())


def load_model(spark: SparkSession, path: str) -> Ridge | Boosted:
    """The stored ranker; its kind is told by the form of its description."""
    text = read_bytes(spark, f"{path}/model.json").decode()
    form = json.loads(text)
    if form.get("model_type") == "linear_ridge" or "coef" in form:
        return Ridge.from_json(text)
    if form.get("model_type") != "boosted_trees":
        raise ValueError(f"no ranker is known by this form: {sorted(form)}")
    out = Boosted(form["feature_cols"], form["rounds"], form["depth"], form["seed"])
    if form["fitted"]:
        from pyspark.ml.regression import GBTRegressionModel

        out.model = GBTRegressionModel.load(f"{path}/trees")
    return out


def cross_boosted(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    """``df`` ranked fold by fold by a boosted ranker fitted on all other folds; every row is ranked once."""
    out = None
    for fold in sorted(r["fold"] for r in df.select("fold").distinct().collect()):  # one row a fold
        got = boosted_ranker(df.filter(F.col("fold") != fold), columns, **kw)(df.filter(F.col("fold") == fold))
        got = got.select("query_id", "doc_id", "fold", "final_score", "final_rank")
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no rows to rank")
    return out


def union_matrix(candidates: DataFrame, relevant: DataFrame | None = None) -> DataFrame:
    """Whole-number ranks (999 where a branch lacks the document), scores, number of sources and label of fused candidates."""
    names = [c for c in candidates.columns if c.endswith(("_rank", "_score")) and c not in ("final_rank", "final_score")]
    cols = [F.coalesce(F.col(c).cast("int"), F.lit(999)).alias(c) if c.endswith("_rank") else safe_number(F.col(c)).alias(c) for c in names]
    out = candidates.select("query_id", "doc_id", "source_count", *cols)
    if relevant is None:
        return out
    gold = relevant.select("query_id", "doc_id", F.lit(1).alias("label")).distinct()
    return out.join(gold, ["query_id", "doc_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def parameter_budget(parts: dict[str, int], most: int = 4_000_000_000) -> tuple[int, bool]:
    """Total learned parameters and whether they stay below the limit."""
    total = sum(parts.values())
    return total, total < most


def projected_seconds(measured: float, done: int, total: int, fixed: float = 0.0) -> float:
    """Seconds for ``total`` units from a measured part, with a share that does not grow."""
    if done <= 0 or measured < fixed:
        raise ValueError("a projection needs finished work")
    return fixed + (measured - fixed) * total / done
