import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import components as K
from siltstone.llm import splits as S


def roots(nodes, ties):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in ties:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_solve_against_union_find(spark, seed):
    r = random.Random(seed)
    names = [f"{r.random():.9f}" for _ in range(120)]
    ties = [(r.choice(names), r.choice(names)) for _ in range(70)] + [(names[i], names[i + 1]) for i in range(40)]  # a long chain too
    got = {x["node"]: x["root"] for x in K.solve(spark.createDataFrame(ties, "a string, b string").filter("a != b")).collect()}
    want = roots(names, ties)
    assert got == {n: want[n] for n in {x for t in ties if t[0] != t[1] for x in t}}


def test_star_with_a_hot_centre(spark):
    ties = spark.range(4000).select(F.lit("0").alias("a"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("b"))
    got = K.solve(ties)
    assert got.count() == 4001 and got.filter("root != '0'").count() == 0


def test_extension_keeps_and_merges(spark):
    nodes = lambda x: spark.createDataFrame([(n,) for n in x], "node string")
    ties = lambda x: spark.createDataFrame(x, "a string, b string")
    one, _ = K.extend(None, nodes("abcdx"), ties([("b", "a"), ("c", "d")]))
    assert {r[0]: r[1] for r in one.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x"}
    two, merges = K.extend(one, nodes("ey"), ties([("e", "d"), ("b", "c")]))
    assert {r[0]: r[1] for r in two.collect()} == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "y"}
    assert {tuple(r) for r in merges.collect()} == {("a", "a"), ("c", "a")}
    three, _ = K.extend(two, nodes(""), ties([]))
    assert three.count() == 7


@pytest.fixture
def tables(spark):
    t = "timestamp'2024-01-01'"
    q = spark.sql(f"select * from values ('q1','a',{t}),('q2','a',{t}),('q3',null,{t}),('q4','b',{t}),('q4','b',{t}),('q5','',{t}),(null,'a',{t}) as v(query_id, question_norm, kind)")
    d = spark.sql(f"select * from values ('d1',' 1/2020 ',{t}),('d2','1/2020',{t}),('d3','  ',{t}),('d4',null,{t}) as v(doc_id, legal_number, node)")
    r = spark.sql("select * from values (1,' q2 ','d1',1),(2,'q3','d2',1),(3,'q4','d9',1),(4,'q4','d4',0),(5,'nan','d1',1),(6,'q9','d3',1),(7,'q4','d3',null) as v(qrel_id, query_id, document_id, relevance)")
    s = spark.sql("select * from values (array('q1',null,'q1'), array('q5'), array('d9','q'), array('d2')) as v(train_qids, val_qids, train_doc_ids, val_doc_ids)")
    return q, d, r, s


def test_conflicts(tables, rows):
    """Chains over questions, documents and acts; a document unknown to the tables; hub keys that are blank; repeated rows."""
    q, d, r, s = tables
    state, _ = S.extended(None, *S.legal_records(q, d, r), S.stored_sides(s))
    assert rows(S.conflicts(state, q)) == [("q1", "q1"), ("q1", "q2"), ("q1", "q3")]


def test_one_record_on_both_sides(tables, spark, rows):
    q, d, r, _ = tables
    s = spark.sql("select array('q4') as train_qids, array('q4') as val_qids, array('x') as train_doc_ids, cast(null as array<string>) as val_doc_ids")
    assert rows(S.conflicts(S.extended(None, *S.legal_records(q, d, r), S.stored_sides(s))[0], q)) == [("q4", "q4")]


def test_split_keeps_groups_together(tables, rows):
    q, d, r, s = tables
    got = S.split(S.extended(None, *S.legal_records(q, d, r), S.stored_sides(s))[0]).collect()
    side = {(x["kind"], x["record_id"]): (x["component"], x["side"], x["quarantined"]) for x in got}
    assert side["query", "q1"][2] and side["query", "q1"][1] is None and side["query", "q1"] == side["document", "d2"] == side["query", "q3"]
    assert side["query", "q5"][1:] == ("validation", False) and side["query", "q4"] == side["document", "d9"] and side["query", "q4"][1] == "train"
    by = {}
    for c, sd, _ in side.values():
        by.setdefault(c, set()).add(sd)
    assert all(len(v) == 1 for v in by.values()) and side["document", "d4"][1] in S.SIDES


def test_proportions_and_stored_sides(spark):
    c = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("root"), F.lit(1).cast("long").alias("n_records"), F.when(F.col("id") < 1000, F.array(F.lit("test"))).alias("held"))
    big = spark.range(3).select(F.unhex(F.md5(F.concat(F.lit("b"), F.col("id").cast("string")))).alias("root"), F.lit(2000).cast("long"), F.lit(None).cast("array<string>"))
    got = S.assign(c.union(big))
    n = {r["side"]: r["n"] for r in got.groupBy("side").agg(F.sum("n_records").alias("n")).collect()}
    assert sum(n.values()) == 26_000
    for s, p in S.SIDES.items():
        assert abs(n[s] / 26_000 - p) < 0.02
    assert got.join(c.filter("held is not null"), "root").filter("side != 'test'").count() == 0


def test_batches_equal_one_solve(tables, spark, rows, tmp_path):
    """A stored state extended by the judgements has the components of one solve; sides that a batch gave are kept."""
    q, d, r, s = tables
    first, later = S.legal_batches(q, d, r)
    state, _ = S.extended(None, *first, S.stored_sides(s))
    S.save(state, str(tmp_path / "state"))
    state = S.load(spark, str(tmp_path / "state"))
    before = {x["record_id"]: x["side"] for x in S.split(state).collect()}
    two, merges = S.extended(state, *later, None)
    one, _ = S.extended(None, *S.legal_records(q, d, r), S.stored_sides(s))
    assert rows(S.components(two)) == rows(S.components(one)) and merges.count() > 0
    after = {x["record_id"]: (x["side"], x["quarantined"]) for x in S.split(two).collect()}
    for k, side in before.items():
        assert after[k] == (side, False) or after[k] == (None, True)
    assert after["q1"] == (None, True) and after["q5"] == ("validation", False)
    again, none = S.extended(two, *later, None)
    assert rows(S.split(again)) == rows(S.split(two)) and none.filter("old_root != root").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 20])
def test_proportions_by_component_size(spark, size):
    """50,000 components of one size, named by their smallest md5 as the operator does, meet the proportions."""
    c = spark.range(50_000).select(F.array_min(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.md5(F.concat_ws("-", F.col("id"), k)))).alias("h"))
    c = c.select(F.unhex("h").alias("root"), F.lit(size).cast("long").alias("n_records"), F.lit(None).cast("array<string>").alias("held"))
    n = {r["side"]: r["n"] for r in S.assign(c).groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    for s, p in S.SIDES.items():
        assert abs(n[s] / 50_000 - p) < 0.01


def test_empty(tables, spark):
    q, d, r, s = (t.limit(0) for t in tables)
    assert S.conflicts(S.extended(None, *S.legal_records(q, d, r), S.stored_sides(s))[0], q).count() == 0
    assert S.split(S.extended(None, *S.legal_records(q, d, r), S.stored_sides(s))[0]).count() == 0
