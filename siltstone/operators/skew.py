"""Joins that stay balanced when one key holds a large share of the rows.

Heavy keys are found by a sample of the key columns: keys that would fill more
than their task's share.  Only these are spread, over a number of salts in
proportion to their share; a lookup row is repeated for the salts of its own
key alone, so a join without heavy keys is an ordinary join.  The list of heavy
keys has at most one key a task and is all that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, LEAST_SEEN, SMALL = 1 / 64, 24, 200_000


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def heavy_keys(rows: DataFrame, keys: list[str], sample: float = SAMPLE) -> dict[tuple, int]:
    """Salts of each key that holds over half a task's share of ``rows``; found in a sample, at most two keys a task.

    A key seen under ``LEAST_SEEN`` times in the sample is not heavy, so a small
    table has none.  Null keys match nothing and are not counted.
    """
    tasks = _tasks(rows)
    some = rows.select(*keys).dropna().sample(False, sample, 11)
    # The grand total comes with the counts, as the largest row of the roll-up.
    top = some.select(F.struct(*keys).alias("k")).rollup("k").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    got = top.filter(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), F.desc("g")).limit(2 * tasks + 1).collect()
    total = sum(r["n"] for r in got if r["g"])
    return {tuple(r["k"]): math.ceil(2 * tasks * r["n"] / total) for r in got if not r["g"] and 2 * tasks * r["n"] > total}


def _salts(rows: DataFrame, keys: list[str], heavy: dict[tuple, int], name: str) -> DataFrame:
    """``rows`` with the number of salts of their key, 1 unless it is heavy."""
    schema = rows.select(*keys).schema.add(name, "integer")
    few = rows.sparkSession.createDataFrame([(*k, n) for k, n in heavy.items()], schema)
    return rows.join(F.broadcast(few), keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))  # at most two rows a task


def _spread(spread: list[str], n: str) -> F.Column:
    return F.pmod(F.xxhash64(*spread), F.col(n)).cast("int")


def salted(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], seen: DataFrame | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the columns to join them on, so that no task holds all ``rows`` of a heavy key."""
    heavy = {} if n is not None and n < SMALL else heavy_keys(rows if seen is None else seen, keys)
    if not heavy:
        return rows, lookup, keys
    columns = [*keys, *[c for c in rows.columns if c not in keys]]
    left = _salts(rows, keys, heavy, "_n").withColumn("_salt", _spread(spread, "_n")).select(*columns, "_salt")
    right = _salts(lookup, keys, heavy, "_n").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left, right, [*keys, "_salt"]


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], how: str = "inner", seen: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Join many ``rows`` to a ``lookup`` of few rows a key.

    Rows of a heavy key are spread over tasks by a hash of the columns in
    ``spread``, and the lookup's rows of that key are repeated once a salt.
    ``seen`` is a cheaper frame with the same keys to find heavy ones in; with
    ``n`` rows below ``SMALL``, where known, any task can hold them all.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.  Null keys
    match nothing, as in any equi-join.
    """
    left, right, on = salted(rows, lookup, keys, spread, seen, n)
    return left.join(right, on, how).drop("_salt")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], spread: tuple[list[str], list[str]], seen: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Inner join of two sides that may both hold a key without bound.

    A key that is heavy on either side is cut into a grid: rows of each side are
    spread over its own salts and repeated over the salts of the other, so the
    pairs of one key are made by as many tasks as the grid has cells.
    """
    a, b = (heavy_keys(s, keys) for s in (seen or (left, right)))
    if not a and not b:
        return left.join(right, keys)
    both = {k: (a.get(k, 1), b.get(k, 1)) for k in a | b}

    def cells(df: DataFrame, own: int, columns: list[str]) -> DataFrame:
        df = _salts(df, keys, {k: n[own] for k, n in both.items()}, "_own")
        df = _salts(df, keys, {k: n[1 - own] for k, n in both.items()}, "_other")
        names = ("_i", "_j") if own == 0 else ("_j", "_i")
        df = df.withColumn(names[0], _spread(columns, "_own")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
        return df.drop("_own", "_other")

    return cells(left, 0, spread[0]).join(cells(right, 1, spread[1]), [*keys, "_i", "_j"]).drop("_i", "_j")
