"""Folds and document-disjoint divisions, and the checks that they are what they claim."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.skew import salted_join
from siltstone.storage import cut


def bucket_folds(queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, fold`` by md5: needs no list of ids, and an id keeps its fold when others come or go."""
    h = F.conv(F.substring(F.md5("query_id"), 1, 8), 16, 10).cast("bigint")
    return queries.select("query_id").dropna().distinct().withColumn("fold", h % k)


def shuffled_folds(ids: list[str], seed: int = 42, k: int = 5) -> list[tuple[str, int]]:
    """The seeded shuffle of a small id list that reproduces published folds: equal slices, the last with the remainder."""
    order = sorted(set(map(str, ids)))
    random.Random(seed).shuffle(order)
    k = max(2, min(k, len(order)))
    size = max(1, len(order) // k)
    return [(q, min(i // size, k - 1)) for i, q in enumerate(order)]


def _seeded(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def running(df: DataFrame, key: str, seed: int, amount: F.Column) -> DataFrame:
    """``df`` with ``before``, the sum of ``amount`` over all rows that precede in the order of a seeded hash of ``key``, and ``everything``.

    Rows are ordered inside 4096 buckets of the hash, and only the buckets' sums
    meet in one task, so the order is exact at any size.
    """
    rows = df.withColumn("_h", _seeded(key, seed)).withColumn("_b", F.substring("_h", 1, 3)).withColumn("_n", amount)
    w = Window.orderBy("_b")
    buckets = rows.groupBy("_b").agg(F.sum("_n").alias("s")).select("_b", (F.sum("s").over(w) - F.col("s")).alias("_base"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("everything"))  # 4096 rows
    own = Window.partitionBy("_b").orderBy("_h", key)
    return rows.withColumn("before", F.sum("_n").over(own) - F.col("_n")).join(F.broadcast(buckets), "_b").withColumn("before", F.col("before") + F.col("_base")).drop("_h", "_b", "_n", "_base")


def random_folds(queries: DataFrame, seed: int = 42, k: int = 5) -> DataFrame:
    """``query_id, fold``: the ids in the order of a seeded hash cut into ``k`` equal slices, the last with the remainder.

    ``shuffled_folds`` reproduces published folds of small id lists.
    """
    ids = running(queries.select(F.col("query_id").cast("string").alias("query_id")).dropna().distinct(), "query_id", seed, F.lit(1).cast("long"))
    n = F.col("everything")
    parts = F.greatest(F.lit(2), F.least(F.lit(k), n))
    size = F.greatest(F.lit(1), F.floor(n / parts))
    return ids.select("query_id", F.least(F.floor(F.col("before") / size), parts - 1).cast("int").alias("fold"))


def question_components(relevant: DataFrame) -> DataFrame:
    """``query_id, component``: queries that share relevant documents, directly or over others; the smallest id names them.

    Every round sends the least label over the documents and back and shortens
    it by the label's own label; rounds are written to the shared folder.
    """
    ties = cut(relevant.select("query_id", "doc_id").dropna().distinct(), "ties")
    labels = cut(ties.select("query_id").distinct().withColumn("component", F.col("query_id")), "labels")
    while True:
        near = salted_join(ties, labels, ["query_id"], ["doc_id"]).groupBy("doc_id").agg(F.min("component").alias("component"))
        seen = salted_join(ties, near, ["doc_id"], ["query_id"]).groupBy("query_id").agg(F.min("component").alias("seen"))
        jump = labels.select(F.col("query_id").alias("seen"), F.col("component").alias("jump"))
        new = labels.join(seen, "query_id").transform(lambda x: salted_join(x, jump, ["seen"], ["query_id"]))
        new = cut(new.select("query_id", F.least("component", "seen", "jump").alias("component"), (F.least("seen", "jump") < F.col("component")).alias("moved")), "labels")
        if not new.filter("moved").limit(1).count():
            return new.select("query_id", "component")
        labels = new.select("query_id", "component")


def greedy_side(components: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``component, side``: components in the order of a seeded hash go to validation while they all fit its target; the first always does."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    r = running(sizes, "component", seed, F.col("n"))
    fits = (F.col("before") + F.col("n") <= F.floor(F.col("everything") * val_ratio)) | (F.col("before") == 0)
    return r.select("component", F.when(fits, "val").otherwise("train").alias("side"))


def document_disjoint(relevant: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``query_id, component, side`` with no relevant document on both sides."""
    c = question_components(relevant)
    return salted_join(c, greedy_side(c, val_ratio, seed), ["component"], ["query_id"])


def fold_violations(folds: DataFrame, queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """``check_name, n``: numbers that are all 0 for sound folds."""
    n = folds.select("fold").distinct().count()
    twice = folds.groupBy("query_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1")
    rows = {
        "fewer than two folds": folds.sparkSession.range(1).filter(F.lit(n < 2)), "query in several folds": twice, "query without fold": queries.select("query_id").distinct().join(folds, "query_id", "left_anti"),
        "fold query unknown": folds.join(queries, "query_id", "left_anti"), "fold query without relevant document": folds.join(relevant, "query_id", "left_anti"),
    }
    return _counted(rows)


def disjoint_violations(sides: DataFrame, relevant: DataFrame) -> DataFrame:
    """``check_name, n`` for a division ``query_id, side`` that must not share queries or relevant documents."""
    both = lambda df, key: df.groupBy(key).agg(F.count_distinct("side").alias("n")).filter("n > 1")
    docs = salted_join(relevant.select("query_id", "doc_id").dropna(), sides.select("query_id", "side").distinct(), ["query_id"], ["doc_id"])
    return _counted({"query on both sides": both(sides, "query_id"), "relevant document on both sides": both(docs, "doc_id")})


def _counted(rows: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in rows.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def overlap(fit: DataFrame, evaluation: DataFrame, key: str = "query_id") -> DataFrame:
    """Ids that a fitted table shares with an evaluated one; must be empty."""
    return fit.select(key).distinct().join(evaluation.select(key).distinct(), key, "left_semi")


def subset(queries: DataFrame, relevant: DataFrame, docs: DataFrame, n_queries: int, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """A repeatable small set: queries by md5 order, all their relevant documents, and others up to ``n_docs``."""
    q = queries.select("query_id").distinct().orderBy(F.md5("query_id")).limit(n_queries)
    need = relevant.join(q, "query_id", "left_semi").select("doc_id").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("positive", F.lit(True))
    room = max(0, n_docs - need.count())
    others = docs.select("doc_id").distinct().join(need, "doc_id", "left_anti").orderBy(F.md5("doc_id")).limit(room).withColumn("positive", F.lit(False))
    return q, need.unionByName(others)


def folds_from_json(spark, path: str) -> DataFrame:
    """``fold, side, query_id`` of a stored list of folds, under either name of its id lists."""
    text = spark.read.text(path, wholetext=True)
    one = "struct<fold:int,train:array<string>,val:array<string>,train_query_ids:array<string>,val_query_ids:array<string>>"
    rows = text.select(F.posexplode(F.from_json("value", f"array<{one}>")).alias("i", "f"))
    fold = F.coalesce("f.fold", "i")
    sides = {"train": F.coalesce("f.train_query_ids", "f.train"), "val": F.coalesce("f.val_query_ids", "f.val")}
    out = [rows.select(fold.alias("fold"), F.lit(s).alias("side"), F.explode(c).alias("query_id")) for s, c in sides.items()]
    return out[0].union(out[1]).distinct()


def disjoint_from_json(spark, path: str, relevant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query_id, side`` and ``doc_id, side`` of a stored division; documents it lacks follow from the judgements."""
    text = spark.read.text(path, wholetext=True)
    lists = [f"{s}{x}:array<string>" for s in ("train", "val") for x in ("", "_query_ids", "_doc_ids")]
    j = text.select(F.from_json("value", f"struct<{','.join(lists)}>").alias("j")).select("j.*")
    queries = docs = None
    for s in ("train", "val"):
        q = j.select(F.explode(F.coalesce(f"{s}_query_ids", s)).alias("query_id"), F.lit(s).alias("side"))
        stored = j.select(F.explode(f"{s}_doc_ids").alias("doc_id"), F.lit(s).alias("side"))
        follow = relevant.join(q, "query_id").join(j.filter(F.col(f"{s}_doc_ids").isNull()).select(F.lit(s).alias("side")), "side").select("doc_id", "side")
        queries, docs = (q, stored.union(follow)) if queries is None else (queries.union(q), docs.union(stored).union(follow))
    return queries.distinct(), docs.distinct()


def write_splits(queries: DataFrame, relevant: DataFrame, path: str, seed: int = 42, k: int = 5, val_ratio: float = 0.2) -> dict[str, int]:
    """Create both divisions, store them as tables, and return the violations found, all 0."""
    folds, sides = cut(random_folds(queries, seed, k), "folds"), cut(document_disjoint(relevant, val_ratio, seed), "sides")
    folds.write.mode("overwrite").parquet(f"{path}/random_folds")
    sides.write.mode("overwrite").parquet(f"{path}/document_disjoint")
    found = fold_violations(folds, queries, relevant).union(disjoint_violations(sides, relevant))
    return {r["check_name"]: r["n"] for r in found.collect()}
