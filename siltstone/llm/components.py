"""Connected components kept as a table, extended by batches of ties.

Nodes are named by the md5 of their label, so that the smallest neighbour of a
node is a random one and chains of pointers stay short.  A batch of ties is
first lifted to the roots of the stored table; only roots that the batch
touches take part.  Each round lets every node point to its smallest neighbour,
shortens the pointers by jumping until all point at a root, and contracts the
ties to the roots; ties inside one root vanish.  The number of rounds grows
with the logarithm of the nodes.  Every round is written to the shared folder
and removed once the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.skew import salted_join
from siltstone.storage import cut, drop


def _jump(parents: DataFrame) -> tuple[DataFrame, int]:
    """Pointers ``node, root`` shortened until every root points to itself, and their number."""
    spark, n = parents.sparkSession, parents.count()
    while True:
        # Only nodes that are no roots can shorten a pointer.
        up = parents.filter("node != root").select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut(salted_join(parents.select("node", "root"), up, ["root"], ["node"], "left", n=n).select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jump")
        drop(spark, parents)
        parents = new
        if not parents.filter("moved").limit(1).count():
            return parents.select("node", "root"), n


def solve(ties: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``ties(a, b)``; the root is the smallest node of its component."""
    spark = ties.sparkSession
    ties = cut(ties.select("a", "b").distinct(), "ties")
    done = None
    while True:
        both = ties.select(F.col("a").alias("node"), F.col("b").alias("other")).union(ties.select(F.col("b"), F.col("a")))
        parents, n = _jump(cut(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("root")), "hook"))
        if done is None:
            done, n_done = parents, n
        else:
            up = parents.filter("node != root").select(F.col("node").alias("root"), F.col("root").alias("above"))
            old, done = done, cut(salted_join(done, up, ["root"], ["node"], "left", n=n_done).select("node", F.coalesce("above", "root").alias("root")), "done")
            drop(spark, old)
        rest, n_ties = ties, ties.count()
        a = salted_join(ties.select(F.col("a").alias("node"), "b"), parents, ["node"], ["b"], n=n_ties).select(F.col("root").alias("a"), F.col("b").alias("node"))
        ties = cut(salted_join(a, parents, ["node"], ["a"], seen=ties.select(F.col("b").alias("node")), n=n_ties).select("a", F.col("root").alias("b")).filter("a != b").distinct(), "ties")
        drop(spark, rest)
        if done is not parents:
            drop(spark, parents)
        if not ties.limit(1).count():
            return done


def extend(stored: DataFrame | None, nodes: DataFrame, ties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge a batch into a stored component table.

    ``stored(node, root)``; ``nodes(node)`` new or known nodes; ``ties(a, b)``.
    Returns the new table and ``merges(old_root, root)`` of the stored roots
    whose component the batch touched.
    """
    ties = ties.filter("a != b")
    if stored is None:
        solved = solve(ties)
        table = nodes.select("node").distinct().join(solved, "node", "full").select("node", F.coalesce("root", "node").alias("root"))
        return cut(table, "components"), solved.select(F.col("node").alias("old_root"), "root").limit(0)
    ties = cut(ties.select("a", "b").distinct(), "batch")
    n = ties.count()
    lifted = ties
    for c, other in (("a", "b"), ("b", "a")):
        up = stored.select(F.col("node").alias(c), "root")
        lifted = salted_join(lifted, up, [c], [other], "left", seen=ties, n=n).withColumn(c, F.coalesce("root", c)).select("a", "b")
    solved = solve(lifted.filter("a != b"))
    up = solved.filter("node != root").select(F.col("node").alias("root"), F.col("root").alias("above"))
    kept = salted_join(stored, up, ["root"], ["node"], "left").select("node", F.coalesce("above", "root").alias("root"))
    # New nodes: those named, and those of the batch's ties that the stored table lacks.
    known = nodes.select("node").union(ties.select("a")).union(ties.select("b")).distinct()
    fresh = known.join(stored, "node", "left_anti").join(solved, "node", "left")
    table = cut(kept.union(fresh.select("node", F.coalesce("root", "node").alias("root"))), "components")
    merges = solved.join(stored.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("old_root"), "root")
    return table, cut(merges, "merges")
