import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.sources import raw, stores


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, json.dumps(content))


def test_zip_contexts(spark, tmp_path):
    make_zip(tmp_path / "a.zip", {"context_2.json": {"id": 2, "name": "b", "passage": "p"}, "x/context_1.json": {"id": 1, "name": None}, "other.json": {"id": 3}})
    got = {r["id"]: r["name"] for r in raw.zip_contexts(spark, str(tmp_path / "a.zip")).collect()}
    assert got == {"1": None, "2": "b"}
    make_zip(tmp_path / "b.zip", {"context_1.json": {"id": 1}, "context_2.json": {"id": "1"}})
    with pytest.raises(ValueError):
        raw.zip_contexts(spark, str(tmp_path / "b.zip"))
    make_zip(tmp_path / "c.zip", {"other.json": {}})
    with pytest.raises(Exception, match="no context"):
        raw.zip_contexts(spark, str(tmp_path / "c.zip"))


def test_json_contexts(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"context_{i}.json").write_text(json.dumps({"id": i, "name": f"n{i}", "passage": "a\nb"}, indent=1))
    assert raw.json_contexts(spark, str(tmp_path)).orderBy("id").first()["passage"] == "a\nb"


def test_question_map(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"10": {"question": "hỏi", "answer": ["1"]}, "9": "chữ", "x": {"question": "y"}}))
    got = raw.question_map(spark, str(tmp_path / "q.json")).orderBy("place").collect()
    assert [(r["query_id"], r["question"], r["answer"]) for r in got] == [("9", "chữ", None), ("10", "hỏi", ["1"]), ("x", "y", None)]


def test_candidate_cache(spark, tmp_path):
    c = spark.createDataFrame([("q1", "bm25", 1, "a", 0.5), ("q1", "dense", 1, "b", 0.4), ("q2", "bm25", 1, "c", 0.3)], "query_id string, branch string, rank int, doc_id string, score float")
    path = str(tmp_path / "cache")
    stores.write_candidates(c, path)
    assert {r["doc_id"] for r in stores.candidates_of(spark, path, "q1").collect()} == {"a", "b"}
    one = stores.candidates_of(spark, path, "q1", "bm25")
    assert one.count() == 1 and stores.cached_queries(spark, path).count() == 2
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(branch" in plan and "EqualTo(query_id,q1)" in plan
    with pytest.raises(ValueError):
        stores.write_candidates(c.withColumn("label", F.lit(1)), path)


def test_vector_store(spark, tmp_path):
    v = spark.createDataFrame([("a", "d", [1.0, 2.0]), ("b", "d", [0.0, 1.0])], "id string, doc_id string, v array<double>")
    path, rev = f"file://{tmp_path}/v", "a" * 40
    stores.save_vectors(v, path, "m", rev)
    assert stores.load_vectors(spark, path, "m", rev).count() == 2
    assert stores.index_state(spark, path, "m", "b" * 40)[0] == "FAIL" and stores.index_state(spark, f"{path}x", "m", rev)[0] == "BLOCKED"
    for bad in (v.withColumn("v", F.array(F.lit(float("nan")))), v.union(v.withColumn("v", F.array(F.lit(1.0)))), v.limit(0)):
        with pytest.raises(ValueError):
            stores.save_vectors(bad, path + "2", "m", rev)
    with pytest.raises(ValueError):
        stores.save_vectors(v, path + "2", "m", "main")
    assert stores.id_digest(v, "id") == stores.id_digest(v.orderBy(F.desc("id")).repartition(3), "id") != stores.id_digest(v.limit(1), "id")
    with pytest.raises(ValueError):
        stores.vectors_from(v.select("id", "doc_id"), v.select("id", "v").limit(1))


def test_encoded_once(spark, tmp_path):
    calls = []

    def encode(df):
        calls.append(df.count())
        return df.select("id", F.array(F.length("text").cast("double")).alias("v"))

    path = f"file://{tmp_path}/e"
    t = spark.createDataFrame([("1", "ab"), ("2", "ab"), ("3", "xyz")], "id string, text string")
    assert {r["id"]: r["v"] for r in stores.encoded_once(t.limit(2), path, encode).collect()} == {"1": [2.0], "2": [2.0]}
    assert stores.encoded_once(t, path, encode).count() == 3 and stores.encoded_once(t, path, encode).count() == 3
    assert calls == [1, 1]


def test_answer_files(spark, tmp_path):
    a = spark.createDataFrame([("10", ["1"]), ("9", ["2", "3"])], "query_id string, answer array<string>")
    path = f"file://{tmp_path}"
    m = stores.write_answers(a, path)
    data = (tmp_path / "submission.zip").read_bytes()
    assert list(json.loads((tmp_path / "submission.json").read_text())) == ["9", "10"] and stores.zip_errors(data) == [] and m["queries"] == 2
    assert stores.write_answers(a, path) == m
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x", "")
    assert stores.zip_errors(other.getvalue())


def test_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/c.txt").write_text("2")
    first = raw.inventory(spark, str(tmp_path))
    before = spark.createDataFrame(first.collect(), first.schema)
    assert {r["path"] for r in before.collect()} == {"a.txt", "b/c.txt"}
    f = raw.fingerprint(before)
    (tmp_path / "a.txt").write_text("3")
    (tmp_path / "d.txt").write_text("4")
    after = raw.inventory(spark, str(tmp_path))
    assert {tuple(r) for r in raw.inventory_changes(before, after).collect()} == {("a.txt", "changed"), ("d.txt", "new")} and raw.fingerprint(after) != f
    with pytest.raises(ValueError):
        raw.fingerprint(after.withColumn("sha256", F.lit(None).cast("string")))


def test_descriptor_and_places(spark, tmp_path):
    p = f"file://{tmp_path}/m/fusion.json"
    stores.write_descriptor(spark, p, "fixed", "{}", weights={"bm25": 1.0})
    assert stores.read_descriptor(spark, p)["rrf"]["k"] == 60
    assert stores.located(spark, f"file://{tmp_path}", "fusion.json", "m") == p
    with pytest.raises(FileNotFoundError):
        stores.located(spark, f"file://{tmp_path}", "none", "m")


def test_coercion(spark):
    s = "query_id string, question string"
    for x in ({"1": "a"}, {"1": {"question": "a"}}, [{"query_id": "1", "question": "a", "z": 0}], [("1", "a")], spark.createDataFrame([("1", "a", 0)], s + ", z int"), spark.createDataFrame([("1", "a")], s).toPandas()):
        assert [tuple(r) for r in raw.to_df(spark, x, s).collect()] == [("1", "a")]
    assert raw.to_df(spark, ["1"], s).first()["question"] is None


def test_existing_columns_reach_the_scan(spark, tmp_path):
    spark.range(3).selectExpr("id", "id as a", "id as b").write.parquet(str(tmp_path / "t"))
    df = raw.existing(spark.read.parquet(str(tmp_path / "t")), ["a", "zz"])
    assert df.columns == ["a"] and "ReadSchema: struct<a:bigint>" in df._jdf.queryExecution().toString()
    m = raw.footer_metadata(spark, str(tmp_path / "t"))
    assert m.agg(F.sum("n_rows")).first()[0] == 3
