"""Training pairs: negatives that are hard but not wrong, and the order in which they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.ranking import best
from siltstone.operators.skew import salted_join

#: Sources in order of priority with their quotas, and quotas by difficulty.
QUOTAS = {"exact": 2, "hybrid": 3, "near_miss": 3, "dense": 1, "memory": 1, "medium_neg": 2, "bm25": 2, "bm25_pyvi": 1}
BANDS = {"very_hard": 5, "hard": 5, "medium": 5}


def difficulty(rank: Column) -> Column:
    return F.when(rank <= 5, "very_hard").when(rank <= 20, "hard").otherwise("medium")


def classes(groups: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_members`` of ``group_id, doc_id``: the closure of duplicate groups as membership.

    Two documents are duplicates if they have one class, named by its smallest
    document; no pairs are written.
    """
    g = groups.select("group_id", "doc_id").dropna().distinct()
    of = g.groupBy("group_id").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    return salted_join(g, of, ["group_id"], ["doc_id"]).select("doc_id", "class_id", "n_members")


def blacklist(candidates: DataFrame, relevant: DataFrame, groups: DataFrame) -> DataFrame:
    """``query_id, doc_id`` among the candidates that are no negatives: relevant documents and their duplicates.

    Candidates are looked up by their group, so a group of many copies is never
    spread over the queries it is relevant for.
    """
    gold = relevant.select("query_id", "doc_id").dropna().distinct()
    member = groups.select("group_id", "doc_id").dropna().distinct()
    c = candidates.select("query_id", "doc_id").dropna().distinct()
    banned = salted_join(gold, member, ["doc_id"], ["query_id"]).select("query_id", "group_id").distinct()
    copies = salted_join(c, member, ["doc_id"], ["query_id"]).join(banned, ["query_id", "group_id"], "left_semi").select("query_id", "doc_id")
    return c.join(gold, ["query_id", "doc_id"], "left_semi").union(copies).distinct()


def bands_of(fused: DataFrame, branches: DataFrame) -> DataFrame:
    """Candidates by source: fused ranks 1-30, 3-15 and 21-80, and the first 30 of each branch.

    Both sides have ``query_id, doc_id, rank, score``; ``branches`` also ``branch``.
    """
    cuts = {"hybrid": (1, 30), "near_miss": (3, 15), "medium_neg": (21, 80)}
    out = branches.filter("rank <= 30").select("query_id", F.col("branch").alias("source"), "doc_id", "rank", "score")
    for name, (low, high) in cuts.items():
        out = out.unionByName(fused.filter(F.col("rank").between(low, high)).select("query_id", F.lit(name).alias("source"), "doc_id", "rank", "score"))
    return out


def _fold(rows: DataFrame, order: Column, kind: str, quotas: dict[str, int], default: int, most: int) -> DataFrame:
    """Per query, take rows in order unless their document is taken, their kind's quota or the total is full."""
    g = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(order)).alias("all"))

    def quota(k: Column) -> Column:
        out = F.lit(default)
        for name, n in quotas.items():
            out = F.when(k == name, F.lit(n)).otherwise(out)
        return out

    def step(taken: Column, x: Column) -> Column:
        seen = F.exists(taken, lambda t: t["doc_id"] == x["doc_id"])
        full = F.size(F.filter(taken, lambda t: t[kind] == x[kind])) >= quota(x[kind])
        return F.when(seen | full | (F.size(taken) >= most), taken).otherwise(F.concat(taken, F.array(x)))

    chosen = F.aggregate("all", F.slice("all", F.lit(1), F.lit(0)), step)
    return g.select("query_id", F.posexplode(chosen).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("n"), "x.doc_id", "x.source", "x.rank", "x.score", "x.band")


def _allowed(candidates: DataFrame, banned: DataFrame) -> DataFrame:
    ok = candidates.filter("doc_id is not null and doc_id != ''").join(banned, ["query_id", "doc_id"], "left_anti")
    return ok.withColumn("band", difficulty(F.col("rank")))


def flat(candidates: DataFrame, banned: DataFrame, most: int = 15) -> DataFrame:
    """The first ``most`` allowed documents of each query by ``rank``."""
    one = _allowed(candidates, banned).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return best(one, ["query_id"], [F.asc("rank"), F.asc("doc_id")], most, "n").withColumn("band", difficulty(F.col("rank")))


def by_source(candidates: DataFrame, banned: DataFrame, quotas: dict[str, int] = QUOTAS, most: int = 15) -> DataFrame:
    """Negatives source by source in order of ``quotas``; sources not named there follow with a quota of 3.

    A document that an earlier source passed over for its quota may still be
    taken by a later one.  A row is passed over only for one of the ``most``
    taken documents or a full quota, so no row behind the first ``most`` plus
    the quota of its source can matter and none is collected.
    """
    place = F.lit(len(quotas))
    for i, name in enumerate(quotas):
        place = F.when(F.col("source") == name, i).otherwise(place)
    rows = best(_allowed(candidates, banned), ["query_id", "source"], [F.asc("rank"), F.asc("doc_id")], most + max(3, *quotas.values()), "_r")
    order = F.struct(place.alias("p"), F.col("source").alias("s"), "rank", "doc_id", "source", "score", "band")
    return _fold(rows, order, "source", quotas, 3, most)


def by_band(candidates: DataFrame, banned: DataFrame, quotas: dict[str, int] = BANDS, most: int = 15) -> DataFrame:
    """Negatives band by band, hardest first; within a band by source order and rank."""
    place, source = F.lit(len(quotas)), F.lit(len(QUOTAS))
    for i, name in enumerate(quotas):
        place = F.when(F.col("band") == name, i).otherwise(place)
    for i, name in enumerate(QUOTAS):
        source = F.when(F.col("source") == name, i).otherwise(source)
    rows = best(_allowed(candidates, banned), ["query_id", "source", "band"], [F.asc("rank"), F.asc("doc_id")], most + max(5, *quotas.values()), "_r")
    order = F.struct(place.alias("p"), source.alias("s"), F.col("source").alias("t"), "rank", "doc_id", "source", "score", "band")
    return _fold(rows, order, "band", quotas, 5, most)


def reranker_pairs(positives: DataFrame, negatives: DataFrame, texts: DataFrame, questions: DataFrame, folds: DataFrame) -> DataFrame:
    """Pair rows with label, source, rank, score, evidence and fold; only queries with question and fold."""
    pos = positives.select("query_id", "doc_id", F.lit(1.0).cast("float").alias("label"), F.lit("positive").alias("negative_source"), F.lit(0).alias("retrieval_rank"), F.lit(0.0).cast("float").alias("retrieval_score"))
    neg = negatives.select("query_id", "doc_id", F.lit(0.0).cast("float").alias("label"), F.col("source").alias("negative_source"), F.col("rank").cast("int").alias("retrieval_rank"), F.col("score").cast("float").alias("retrieval_score"))
    return pos.unionByName(neg).join(texts.select("query_id", "doc_id", "evidence_chunk_ids", "evidence_text"), ["query_id", "doc_id"], "left").join(questions.select("query_id", F.col("question").alias("query_text")), "query_id").join(folds, "query_id")


def retriever_triples(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Every relevant document of a query with each of its negatives."""
    return positives.select("query_id", F.col("doc_id").alias("pos_doc_id")).join(negatives.select("query_id", F.col("doc_id").alias("neg_doc_id"), F.col("n").alias("neg_n")), "query_id")


def coverage(pairs: DataFrame, expected: DataFrame) -> DataFrame:
    """How many expected queries have pairs, positives, negatives and both, with percentages."""
    have = pairs.groupBy("query_id").agg(F.max((F.col("label") > 0.5).cast("int")).alias("p"), F.max((F.col("label") <= 0.5).cast("int")).alias("n"))
    e = expected.select("query_id").distinct().join(have, "query_id", "left")
    share = lambda c: F.round(100.0 * F.sum(c) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2)
    p, n = F.coalesce("p", F.lit(0)), F.coalesce("n", F.lit(0))
    return e.agg(F.count(F.lit(1)).alias("expected"), F.count("p").alias("in_pairs"), F.sum(p).alias("with_positive"), F.sum(n).alias("with_negative"), F.sum(p * n).alias("eligible"), share(p).alias("positive_pct"), share(n).alias("negative_pct"), share(p * n).alias("eligible_pct"))


def balanced_order(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """``pairs`` with ``round`` and ``query_place``: each round takes the next positive and negative of every query.

    Queries with both come first, in an order by md5 of seed and id; sort by
    ``round, query_place, side`` to read.
    """
    w = Window.partitionBy("query_id", "side").orderBy("retrieval_rank", "doc_id")
    p = pairs.withColumn("side", F.when(F.col("label") > 0.5, 0).otherwise(1)).withColumn("round", F.row_number().over(w))
    both = p.groupBy("query_id").agg((F.count_distinct("side") < 2).cast("int").alias("one_sided"))
    return p.join(both, "query_id").withColumn("query_place", F.concat(F.col("one_sided").cast("string"), F.md5(F.concat(F.lit(f"{seed}:"), "query_id"))))


def sampled_order(pairs: DataFrame, seed: int = 42, epoch: int = 0, blocked: bool = False) -> DataFrame:
    """``pairs`` with the keys ``round, block, query_place, side`` by which an epoch reads them.

    Each round takes the next positive and the next negative of every query,
    queries with both first.  ``blocked`` reads the first round of these class by
    class.  The order of queries changes with the epoch.
    """
    o = balanced_order(pairs, seed + epoch)
    both = F.startswith("query_place", F.lit("0"))
    block = F.when(F.col("round") > 1, 0).when(both, F.col("side")).otherwise(2) if blocked else F.lit(0)
    return o.withColumn("block", block)


def group_order(groups: DataFrame, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Listwise groups with ``round, query_place``: one group of every query a round, in an order of queries that changes with the epoch."""
    w = Window.partitionBy("query_id").orderBy("positive")
    return groups.withColumn("round", F.row_number().over(w)).withColumn("query_place", F.md5(F.concat(F.lit(f"{seed + epoch}:"), "query_id")))


def materialized(make: Callable[[DataFrame], DataFrame], queries: DataFrame, path: str, batches: int = 8) -> DataFrame:
    """Rows that ``make`` gives for ``queries``, made and stored batch by batch of a hash of the ids.

    A batch that was stored whole is not made again, so a run that was cut off
    goes on where it stopped.
    """
    spark = queries.sparkSession
    for b in range(batches):
        target = f"{path}/batch={b}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            make(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(path).drop("batch")


def validation_candidates(candidates: DataFrame, relevant: DataFrame, questions: DataFrame, folds: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Candidates of every question with its relevant documents as JSON, its fold and, where given, evidence."""
    gold = relevant.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_set("doc_id"))).alias("gold_doc_ids"))
    q = questions.select("query_id", F.col("question").alias("query_text")).join(gold, "query_id", "left").withColumn("gold_doc_ids", F.coalesce("gold_doc_ids", F.lit("[]")))
    out = candidates.select("query_id", "doc_id", "rrf_score").join(q, "query_id").join(folds, "query_id")
    out = out.withColumn("evidence_text", F.lit(None).cast("string")) if texts is None else out.join(texts.select("query_id", "doc_id", "evidence_text"), ["query_id", "doc_id"], "left")
    return out.select("query_id", "query_text", "doc_id", "gold_doc_ids", "rrf_score", "evidence_text", "fold")


def listwise_groups(pairs: DataFrame, most: int = 7) -> DataFrame:
    """Each positive with the first ``most`` negatives of its query; queries with one side only are left out."""
    neg = best(pairs.filter("label <= 0.5"), ["query_id"], [F.asc("retrieval_rank"), F.asc("doc_id")], most, "_n").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "doc_id"))), lambda x: x["doc_id"]).alias("negatives"))
    return pairs.filter("label > 0.5").select("query_id", F.col("doc_id").alias("positive")).distinct().join(neg, "query_id")


def required_steps(eligible: int, batch: int = 2, accumulate: int = 8, both_sides: bool = True, target: float = 1.0) -> int:
    """Steps until every eligible query's positive and the target share of negatives have been read."""
    import math

    rows = (eligible if both_sides else 0) + math.ceil(target * eligible)
    return math.ceil(rows / max(1, batch * accumulate))


#: Names under which pair columns may come.
ROLES = {"query": ("query_text", "question", "query"), "positive": ("positive", "pos_text", "positive_text"), "negative": ("negative", "neg_text", "negative_text"), "label": ("label", "target", "relevance"), "text": ("evidence_text", "text", "passage")}


def pair_schema(columns: list[str]) -> tuple[str, dict[str, str]]:
    """``pairwise`` or ``pointwise`` and the column of every role; an error if neither fits."""
    found = {role: next((n for n in names if n in columns), None) for role, names in ROLES.items()}
    if found["query"] and found["positive"] and found["negative"]:
        return "pairwise", {k: found[k] for k in ("query", "positive", "negative")}
    if found["query"] and found["label"] and found["text"]:
        return "pointwise", {k: found[k] for k in ("query", "text", "label")}
    raise ValueError(f"no pair columns among {sorted(columns)}")


def equal_sides(pairs: DataFrame) -> DataFrame:
    """Rows of a pairwise table whose positive and negative text are the same."""
    kind, at = pair_schema(pairs.columns)
    if kind != "pairwise":
        raise ValueError("pointwise pairs have one text")
    return pairs.filter(F.col(at["positive"]) == F.col(at["negative"]))
