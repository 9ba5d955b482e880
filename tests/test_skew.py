from pyspark.sql import functions as F

from siltstone.operators import skew as K


def test_no_heavy_key_is_a_plain_join(spark, rows):
    r = spark.range(5000).select((F.col("id") % 900).alias("k"), "id")
    up = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert K.heavy_keys(r, ["k"]) == {}
    assert K.salted_join(r, up, ["k"], ["id"]).count() == 5000


def test_heavy_key_is_spread(spark, rows):
    """One key holds a third of the rows: it alone gets salts, and the rows stay what they are."""
    r = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    r = r.union(spark.sql("select cast(null as bigint), -1L"))
    up = spark.range(30_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    heavy = K.heavy_keys(r, ["k"])
    assert list(heavy) == [(7,)] and heavy[7,] > 1
    for how in ("inner", "left", "left_semi"):
        got, want = K.salted_join(r, up, ["k"], ["x"], how), r.join(up, ["k"], how)
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_balanced_tasks(spark):
    """A third of two million rows on one key: no task of the join holds more than three times the median."""
    r = spark.range(2_000_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    up = spark.range(2_000_000).select(F.col("id").alias("k"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(old, ("-1", "16", "false"), strict=True):
            spark.conf.set(c, v)
        sizes = sorted(x["n"] for x in K.salted_join(r, up, ["k"], ["x"]).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 2_000_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_grid_join(spark):
    """Both sides hold one key heavily: every pair comes out once."""
    a = spark.range(9000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    b = spark.range(6000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("y"))
    got = K.grid_join(a, b, ["k"], (["x"], ["y"]))
    assert got.count() == a.join(b, "k").count() == got.distinct().count()
    assert K.grid_join(a.limit(0), b, ["k"], (["x"], ["y"])).count() == 0
