"""Raw inputs: JSON documents in folders and zip files, maps of questions, and file metadata."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = re.compile(r"(?:^|/)context_[^/]*\.json$")
CONTEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "link", "passage")])


def zip_contexts(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, link, passage`` of the members ``context_*.json`` of zip files, one task a file.

    A file without such members and a repeated id are errors.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if MEMBER.search(n))
                    if not names:
                        raise ValueError(f"no context_*.json in {p}")
                    rows = [json.loads(z.read(n)) for n in names]
                yield pd.DataFrame([{c: None if r.get(c) is None else str(r[c]) for c in ("id", "name", "link", "passage")} for r in rows])

    return unique_ids(files.mapInPandas(read, CONTEXT))


def json_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a folder of JSON files."""
    return unique_ids(spark.read.schema(CONTEXT).json(f"{folder}/context_*.json", multiLine=True))


def unique_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` unless a key repeats, which raises."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated {key}: {twice[0][0]}")
    return df


def question_map(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, question, answer, place`` of JSON files that map ids to questions.

    A value is an object with ``question`` (and perhaps ``answer``) or the text
    itself.  ``place`` orders ids by number, others after them by text.
    """
    text = spark.read.text(path, wholetext=True)
    item = F.explode(F.from_json("value", "map<string,string>"))
    rows = text.select(item.alias("query_id", "v"))
    o = F.from_json("v", "question string, answer array<string>")
    rows = rows.select("query_id", F.when(F.col("v").startswith("{"), o["question"]).otherwise(F.col("v")).alias("question"), F.when(F.col("v").startswith("{"), o["answer"]).alias("answer"))
    n = F.col("query_id").try_cast("bigint")
    return rows.withColumn("place", F.struct(n.isNull().alias("t"), n.alias("n"), F.col("query_id").alias("s")))


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that exist; the scan reads no other."""
    return df.select(*[c for c in columns if c in df.columns])


def column_batches(df: DataFrame, column: str, batch: int) -> DataFrame:
    """``n_rows, n_values, n_bytes`` of batches of at most ``batch`` rows of one text column; the scan reads no other column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                x = whole.column(0).slice(k, batch)
                n = pc.sum(pc.binary_length(x)).as_py() or 0
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (len(x), len(x) - x.null_count, n)], ["n_rows", "n_values", "n_bytes"])

    return df.select(F.col(column).cast("string")).mapInArrow(work, "n_rows long, n_values long, n_bytes long")


def footer_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``path, n_rows, n_columns, n_row_groups, n_bytes`` of Parquet files from their footers alone."""
    paths = spark.read.parquet(folder).inputFiles()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for p in b["path"]:
                fs, inner = pafs.FileSystem.from_uri(p)
                m = pq.ParquetFile(inner, filesystem=fs).metadata
                rows.append((p, m.num_rows, m.num_columns, m.num_row_groups, fs.get_file_info(inner).size))
            yield pd.DataFrame(rows, columns=["path", "n_rows", "n_columns", "n_row_groups", "n_bytes"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(read, "path string, n_rows long, n_columns long, n_row_groups long, n_bytes long")


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, n_bytes, sha256`` of the files below a folder, read in parallel."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return f.select(F.replace("path", F.lit(_plain(folder) + "/"), F.lit("")).alias("path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def _plain(folder: str) -> str:
    return folder if ":" in folder else "file:" + folder.rstrip("/")


def inventory_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change``: files missing, new or of other content."""
    j = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full")
    return j.filter(~F.equal_null("a", "b")).select("path", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").otherwise("changed").alias("change"))


def fingerprint(files: DataFrame) -> str:
    """sha256 over the sorted digests of an inventory; a file without digest is an error.

    Files are hashed in up to 4096 buckets, so that no list of all files is built.
    """
    if files.filter("sha256 is null").limit(1).count():
        raise ValueError("a file has no digest")
    line = F.concat_ws(":", "path", "sha256")
    buckets = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("f"))
    return hashlib.sha256("".join(r["f"] for r in buckets.orderBy("b").collect()).encode()).hexdigest()


def seal(spark: SparkSession, folder: str, path: str) -> None:
    """Store the inventory of a folder, by which ``broken_seal`` verifies it."""
    inventory(spark, folder).write.parquet(path)


def broken_seal(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """``path, change`` of files that are missing, new or changed since the seal; none for a sound bundle."""
    return inventory_changes(spark.read.parquet(path), inventory(spark, folder))


def to_df(spark: SparkSession, x, schema: str) -> DataFrame:
    """A DataFrame of a frame, a path, a map of ids to values, rows as dicts or tuples, or bare ids."""
    names = T._parse_datatype_string(schema).names
    if isinstance(x, DataFrame):
        return x.select(*[c for c in names if c in x.columns])
    if isinstance(x, str):
        return to_df(spark, spark.read.parquet(x), schema)
    if isinstance(x, pd.DataFrame):
        x = x.to_dict("records")
    if isinstance(x, dict):
        x = [{names[0]: str(k), **(v if isinstance(v, dict) else {names[1]: v})} for k, v in x.items()]
    rows = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) if isinstance(r, (tuple, list)) else (str(r), *[None] * (len(names) - 1)) for r in x]
    return spark.createDataFrame(rows, schema)
