import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import topn as T


def brute(data, n):
    best = {}
    for q, b, d, s in data:
        if None not in (q, b, d, s) and s == s and abs(s) != float("inf"):
            best[q, b, d] = max(s, best.get((q, b, d), -1e300))
    out = []
    for g in {k[:2] for k in best}:
        order = sorted((-s, k[2]) for k, s in best.items() if k[:2] == g)[:n]
        out += [(*g, i, d) for i, (_, d) in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("row_group", [1 << 20, 200])
def test_against_brute_force(spark, row_group):
    """Ties, repeated rows, nulls in every column, non-finite scores and a hot group."""
    r = random.Random(4)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    data = [(r.choice(["hot"] * 4 + ["a", "b", "c", None]), r.choice(["x", "y", None]), r.choice([str(i) for i in range(400)] + [None]), r.choice([*odd, *[round(r.random(), 2) for _ in range(20)]])) for _ in range(6000)]
    df = spark.createDataFrame(data, "q string, b string, d string, score double").withColumns({"item": F.lit(1), "g0": F.lit("clash"), "place": F.lit(None)})
    got = sorted(tuple(x)[:4] for x in T.top_n(df, ["q", "b"], "d", "score", 10, row_group).select("q", "b", "place", "d").collect())
    assert got == brute(data, 10)


def test_row_groups_below_the_nth_score_are_skipped(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [("g", f"{i:05d}", float(10_000 - i // 3)) for i in range(9000)] + [("h", f"{i}", 1.0) for i in range(50)]
    t = pa.table({"g0": [x[0] for x in rows], "item": [x[1] for x in rows], "score": [x[2] for x in rows]})
    pq.write_table(t, tmp_path / "x.parquet", row_group_size=500)
    got, read, skipped = T.read_winners(pq.ParquetFile(tmp_path / "x.parquet"), 1, 10)
    assert skipped >= 15 and read + skipped == 19
    assert sorted(got[got["g0"] == "g"]["item"])[:10] == [f"{i:05d}" for i in range(10)]


def test_small_groups_are_skipped_too(spark):
    """Hundreds of groups in every row group: what lies below all their N-th scores is skipped, and the result is whole."""
    r = random.Random(9)
    data = [(f"q{i % 300}", "x", f"{r.randrange(10**6)}", r.random()) for i in range(60_000)]
    df = spark.createDataFrame(data, "q string, b string, d string, score double")
    path = T.clustered(df, ["q", "b"], "d", "score", 4096)
    n = T.row_groups(spark, path, 2, 10).agg(F.sum("n_read"), F.sum("n_skipped")).first()
    assert n[1] > n[0]
    got = sorted(tuple(x)[:4] for x in T.top_n_clustered(spark, path, 2, 10).select("g0", "g1", "place", "item").collect())
    assert got == brute(data, 10)


def test_stored_table_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", 0.5), ("a", "2", 0.7)], "q string, d string, score double")
    df.write.parquet(str(tmp_path / "t"))
    one = T.stored(spark.read.parquet(str(tmp_path / "t")), ["q"], "d", "score")
    assert T.stored(spark.read.parquet(str(tmp_path / "t")), ["q"], "d", "score") == one
    df.write.mode("append").parquet(str(tmp_path / "t"))
    assert T.stored(spark.read.parquet(str(tmp_path / "t")), ["q"], "d", "score") != one


def test_equal_scores_over_row_groups_are_read(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"g0": ["g"] * 2000, "item": [f"{1999 - i:05d}" for i in range(2000)], "score": [1.0] * 2000})
    pq.write_table(t, tmp_path / "x.parquet", row_group_size=100)
    got, read, skipped = T.read_winners(pq.ParquetFile(tmp_path / "x.parquet"), 1, 3)
    assert skipped == 0 and sorted(got["item"])[:3] == ["00000", "00001", "00002"]


def test_empty(spark):
    df = spark.createDataFrame([], "q string, d string, score float")
    assert T.top_n(df, ["q"], "d", "score", 3).count() == 0
    only = spark.createDataFrame([("a", "1", None)], "q string, d string, score float")
    assert T.top_n(only, ["q"], "d", "score", 3).count() == 0
