"""Top N items within every group, by skipping on row-group statistics.

The rows are written once as a clustered table: range-partitioned by group and
falling score, so that a group lies in one file unless it is large, and within a
file sorted by falling score, so that row groups of many groups fall in score
too.  Range boundaries come from a sample of whole sort keys, so a group with a
third of all rows is cut into several files by score and no task holds it.  A
query opens the files in parallel.  Each task takes the row groups in falling
order of their greatest score and keeps the N-th score of every group so far.
Of a row group it reads the group columns, which are dictionaries of few bytes,
and skips items and scores if its greatest score is strictly below the N-th
score of every group it contains; equal scores are read, because the tie rule may
prefer them.  Only the winners of each file are shuffled and ranked.

``stored`` keeps the clustered table of a source in the shared folder under a
digest of its files, for queries that come back.

Defined results: rows with a null group, item or score and NaN or infinite
scores do not count; an item counts once a group with its highest score; ties
go to the smaller item as a string; fewer than N items give fewer rows; an
empty table gives no rows.  Other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.storage import new_path, shared_dir

ROW_GROUP_BYTES = 1 << 20


def clustered(df: DataFrame, groups: list[str], item: str, score: str, row_group_bytes: int = ROW_GROUP_BYTES, path: str | None = None) -> str:
    """Write the valid rows clustered by group, in files sorted by falling score; returns the folder."""
    s = df[score].cast("double")
    cols = [df[g].cast("string").alias(f"g{i}") for i, g in enumerate(groups)]
    valid = df.select(*cols, df[item].cast("string").alias("item"), s.alias("score")).dropna().filter(~F.isnan("score") & (F.abs("score") != float("inf")))
    keys = [F.col(f"g{i}") for i in range(len(groups))]
    path = path or new_path(df.sparkSession, "clustered")
    valid.repartitionByRange(*keys, F.desc("score"), "item").sortWithinPartitions(F.desc("score"), *keys, "item").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)
    return path


def stored(df: DataFrame, groups: list[str], item: str, score: str, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """The folder of the clustered table of a frame that reads files as they are; written unless it stands already."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    files = []
    for f in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = p.getFileSystem(conf).getFileStatus(p)
        files.append((f, status.getLen(), status.getModificationTime()))
    name = hashlib.sha256(repr((files, groups, item, score, row_group_bytes)).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/clustered-{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return path if done.getFileSystem(conf).exists(done) else clustered(df, groups, item, score, row_group_bytes, path)


def _open(path: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, inner = pafs.FileSystem.from_uri(path)
    return pq.ParquetFile(inner, filesystem=fs)


def read_winners(file, n_keys: int, n: int) -> tuple[pd.DataFrame, int, int]:
    """The winners of one clustered file, and how many row groups were read and skipped."""
    keys = [f"g{i}" for i in range(n_keys)]
    meta = file.metadata
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    tops = []
    for i in range(meta.num_row_groups):
        x = meta.row_group(i).column(at["score"]).statistics
        tops.append(x.max if x is not None and x.has_min_max else float("inf"))
    number: dict[tuple, int] = {}
    nth = np.full(1024, -np.inf)  # of every group met, -inf until it has n items
    kept = pd.DataFrame({"group": np.zeros(0, np.int64), "item": np.zeros(0, object), "score": np.zeros(0)})
    read = 0
    for i in sorted(range(len(tops)), key=lambda i: (-tops[i], i)):
        frame = file.read_row_group(i, columns=keys).to_pandas()
        codes, distinct = pd.factorize(pd.MultiIndex.from_frame(frame)) if n_keys > 1 else pd.factorize(frame[keys[0]])
        own = np.array([number.setdefault(k if n_keys > 1 else (k,), len(number)) for k in distinct], np.int64)
        while len(number) > len(nth):
            nth = np.concatenate([nth, np.full(len(nth), -np.inf)])
        if tops[i] < nth[own].min(initial=np.inf):
            continue
        read += 1
        rows = file.read_row_group(i, columns=["item", "score"]).to_pandas()
        rows.insert(0, "group", own[codes])
        rows = rows[rows["score"].to_numpy() >= nth[rows["group"].to_numpy()]]
        touched = kept["group"].isin(rows["group"].unique())
        rows = pd.concat([kept[touched], rows]).sort_values(["group", "score", "item"], ascending=[True, False, True], kind="stable")
        rows = rows.drop_duplicates(["group", "item"]).groupby("group", sort=False).head(n)
        full = rows.groupby("group", sort=False)["score"].agg(["size", "min"])
        full = full[full["size"] >= n]
        nth[full.index.to_numpy()] = full["min"].to_numpy()
        kept = pd.concat([kept[~touched], rows])
    out = pd.DataFrame(list(number), columns=keys, dtype=object).iloc[kept["group"].to_numpy()].reset_index(drop=True)
    out["item"], out["score"] = kept["item"].to_numpy(), kept["score"].to_numpy()
    return out, read, len(tops) - read


def _files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """One row and one task a file; a file listing is as small as the table's own metadata."""
    files = sorted(spark.read.schema(schema).parquet(path).inputFiles())
    return spark.createDataFrame([(i, p) for i, p in enumerate(files)], "i int, path string").repartitionByRange(len(files), "i") if files else None


def _schema(n_keys: int) -> T.StructType:
    return T.StructType([T.StructField(k, T.StringType()) for k in [*[f"g{i}" for i in range(n_keys)], "item"]] + [T.StructField("score", T.DoubleType())])


def top_n_clustered(spark: SparkSession, path: str, n_keys: int, n: int) -> DataFrame:
    """Top ``n`` of a clustered table: columns ``g0.., place, item, score``."""
    keys, schema = [f"g{i}" for i in range(n_keys)], _schema(n_keys)
    files = _files(spark, path, schema)
    if files is None:
        return spark.createDataFrame([], schema).withColumn("place", F.lit(0)).select(*keys, "place", "item", "score")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                yield read_winners(_open(p), n_keys, n)[0]

    won = files.mapInPandas(work, schema)
    best = won.groupBy(*keys, "item").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "item")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(*keys, "place", "item", "score")


def row_groups(spark: SparkSession, path: str, n_keys: int, n: int) -> DataFrame:
    """``path, n_read, n_skipped`` of every file of a clustered table: what ``top_n_clustered`` reads of it."""
    files = _files(spark, path, _schema(n_keys))
    kind = "path string, n_read long, n_skipped long"
    if files is None:
        return spark.createDataFrame([], kind)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                yield pd.DataFrame([(p, *read_winners(_open(p), n_keys, n)[1:])], columns=["path", "n_read", "n_skipped"])

    return files.mapInPandas(work, kind)


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """The ``n`` highest-scoring items of every group: the group columns, ``place``, the item, the score."""
    path = clustered(df, groups, item, score, row_group_bytes)
    out = top_n_clustered(df.sparkSession, path, len(groups), n)
    return out.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)], "place", F.col("item").alias(item), F.col("score").alias(score))
