import random

import pytest

from siltstone.operators import pairs as N
from siltstone.operators import splits as S


def fold(cands, banned, quotas, default, most, kind):
    taken = []
    for c in cands:
        if c["doc_id"] in banned or any(t["doc_id"] == c["doc_id"] for t in taken):
            continue
        if sum(t[kind] == c[kind] for t in taken) >= quotas.get(c[kind], default) or len(taken) >= most:
            continue
        taken.append(c)
    return [(t["doc_id"], t["source"]) for t in taken]


@pytest.mark.parametrize("kind", ["source", "band"])
def test_ordered_folds(spark, kind):
    """Quotas then repeats: what an earlier source leaves for its quota, a later one may take."""
    r = random.Random(7)
    sources = [*N.QUOTAS, "other"]
    rows, banned = [], []
    for q in range(12):
        for s in sources:
            for i, d in enumerate(r.sample(range(25), r.randint(0, 20)), 1):
                rows.append((f"q{q}", s, str(d), i * r.choice([1, 4]), 0.5))
        banned += [(f"q{q}", str(d)) for d in r.sample(range(25), 3)]
    df, bad = spark.createDataFrame(rows, "query_id string, source string, doc_id string, rank int, score double"), spark.createDataFrame(banned, "query_id string, doc_id string")
    f = N.by_source if kind == "source" else N.by_band
    got = {}
    for x in f(df, bad).orderBy("query_id", "n").collect():
        got.setdefault(x["query_id"], []).append((x["doc_id"], x["source"]))
    for q in {x[0] for x in rows}:
        c = [{"source": x[1], "doc_id": x[2], "rank": x[3], "band": "very_hard" if x[3] <= 5 else "hard" if x[3] <= 20 else "medium"} for x in rows if x[0] == q]
        place = lambda s: list(N.QUOTAS).index(s) if s in N.QUOTAS else 99
        bands = list(N.BANDS)
        c.sort(key=lambda x: (place(x["source"]), x["source"], x["rank"], x["doc_id"]) if kind == "source" else (bands.index(x["band"]), place(x["source"]), x["source"], x["rank"], x["doc_id"]))
        assert got.get(q, []) == fold(c, {d for i, d in banned if i == q}, N.QUOTAS if kind == "source" else N.BANDS, 3 if kind == "source" else 5, 15, kind)


def test_blacklist_and_closure(spark):
    g = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "C"), ("2", "D"), ("2", "E"), (None, "A")], "group_id string, doc_id string")
    assert {tuple(r) for r in N.classes(g).collect()} == {("A", "A", 2), ("B", "A", 2), ("C", "C", 3), ("D", "C", 3), ("E", "C", 3)}
    rel = spark.createDataFrame([("q", "A"), ("q", "Z"), ("q", None)], "query_id string, doc_id string")
    cand = spark.createDataFrame([("q", d) for d in "ABXZC"] + [("r", "A"), ("q", None)], "query_id string, doc_id string")
    assert {tuple(r) for r in N.blacklist(cand, rel, g).collect()} == {("q", "A"), ("q", "B"), ("q", "Z")}


def test_order_and_groups(spark):
    p = spark.createDataFrame([("a", "1", 1.0, 0), ("a", "2", 0.0, 1), ("a", "3", 0.0, 2), ("b", "1", 1.0, 0), ("b", "4", 0.0, 1)], "query_id string, doc_id string, label double, retrieval_rank int")
    o = [(r["round"], r["query_id"], r["side"]) for r in N.balanced_order(p.union(spark.createDataFrame([("c", "9", 1.0, 0)]))).orderBy("round", "query_place", "side").collect()]
    assert [x[0] for x in o] == [1, 1, 1, 1, 1, 2] and o[4][1] == "c" and o[0][1] == o[1][1] and [o[0][2], o[1][2]] == [0, 1]
    g = {(r["query_id"], r["positive"]): r["negatives"] for r in N.listwise_groups(p, 1).collect()}
    assert g == {("a", "1"): ["2"], ("b", "1"): ["4"]}
    cov = N.coverage(p, spark.createDataFrame([("a",), ("b",), ("z",)], "query_id string")).first()
    assert (cov["expected"], cov["in_pairs"], cov["eligible"], cov["positive_pct"]) == (3, 2, 2, 66.67)


def test_schema_and_steps(spark):
    assert N.pair_schema(["question", "positive", "negative"])[0] == "pairwise" and N.pair_schema(["query_text", "label", "text"])[0] == "pointwise"
    with pytest.raises(ValueError):
        N.pair_schema(["question"])
    df = spark.createDataFrame([("q", "a", "a"), ("q", "a", "b")], "question string, positive string, negative string")
    assert N.equal_sides(df).count() == 1
    assert N.required_steps(100) == 13 and N.required_steps(100, both_sides=False) == 7


def test_folds(spark):
    one, two = S.shuffled_folds([str(i) for i in range(100)]), S.shuffled_folds([str(i) for i in reversed(range(100))])
    assert one == two and {f for _, f in one} == set(range(5)) and len(dict(one)) == 100 and all(sum(f == k for _, f in one) == 20 for k in range(5))
    assert [f for _, f in S.shuffled_folds(["a", "b", "c"])] == [0, 1, 2] and S.shuffled_folds([]) == []
    q = spark.createDataFrame([(str(i),) for i in range(300)], "query_id string")
    b = S.bucket_folds(q)
    assert b.count() == 300 and b.groupBy("fold").count().filter("count < 30").count() == 0
    assert b.join(S.bucket_folds(q.limit(50)).withColumnRenamed("fold", "g"), "query_id").filter("fold != g").count() == 0


def test_document_disjoint(spark):
    rel = spark.createDataFrame([(f"q{i}", f"d{i % 20}") for i in range(100)] + [("q0", "d1"), ("q0", None)], "query_id string, doc_id string")
    got = S.document_disjoint(rel)
    assert got.count() == 100 and got.select("component").distinct().count() == 19
    assert {r["n"] for r in S.disjoint_violations(got, rel).collect()} == {0}
    n = got.filter("side = 'val'").count()
    assert 0 < n <= 20
    bad = S.disjoint_violations(spark.createDataFrame([("q0", "train"), ("q20", "val"), ("q0", "val")], "query_id string, side string"), rel)
    assert {r["check_name"]: r["n"] for r in bad.collect()} == {"query on both sides": 1, "relevant document on both sides": 2}
    assert S.document_disjoint(rel.limit(0)).count() == 0


def test_fold_checks(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    f = spark.createDataFrame([("a", 0), ("a", 1), ("x", 1)], "query_id string, fold int")
    got = {r["check_name"]: r["n"] for r in S.fold_violations(f, q, spark.createDataFrame([("a", "d")], "query_id string, doc_id string")).collect()}
    assert got == {"fewer than two folds": 0, "query in several folds": 1, "query without fold": 2, "fold query unknown": 1, "fold query without relevant document": 1}


def test_subset(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(30)], "query_id string")
    rel = spark.createDataFrame([(f"q{i}", f"d{i}") for i in range(30)], "query_id string, doc_id string")
    docs = spark.createDataFrame([(f"d{i}",) for i in range(100)], "doc_id string")
    a, b = S.subset(q, rel, docs, 10, 25)
    assert a.count() == 10 and b.count() == 25 and b.filter("positive").count() == 10
    assert {r[0] for r in S.subset(q, rel, docs, 10, 25)[1].collect()} == {r[0] for r in b.collect()}


def test_stored_splits(spark, tmp_path):
    import json

    (tmp_path / "f.json").write_text(json.dumps([{"fold": 3, "train_query_ids": ["a", "b"], "val_query_ids": ["c"]}, {"train": ["c"], "val": ["a"]}]))
    got = {tuple(r) for r in S.folds_from_json(spark, str(tmp_path / "f.json")).collect()}
    assert got == {(3, "train", "a"), (3, "train", "b"), (3, "val", "c"), (1, "train", "c"), (1, "val", "a")}
    (tmp_path / "d.json").write_text(json.dumps({"train": ["a"], "val_query_ids": ["b"], "val_doc_ids": ["9"]}))
    rel = spark.createDataFrame([("a", "1"), ("b", "2")], "query_id string, doc_id string")
    q, d = S.disjoint_from_json(spark, str(tmp_path / "d.json"), rel)
    assert {tuple(r) for r in q.collect()} == {("a", "train"), ("b", "val")} and {tuple(r) for r in d.collect()} == {("1", "train"), ("9", "val")}
    many = spark.createDataFrame([(f"q{i}", f"d{i // 2}") for i in range(40)], "query_id string, doc_id string")
    assert set(S.write_splits(many.select("query_id"), many, f"file://{tmp_path}/s").values()) == {0}


def test_samplers_and_batches(spark, rows, tmp_path):
    """Rounds interleave or block the classes of a query; an epoch reorders queries; a lost batch is made again alone."""
    data = [("a", "p1", 1.0, 0), ("a", "n1", 0.0, 1), ("a", "n2", 0.0, 2), ("b", "p2", 1.0, 0), ("b", "n3", 0.0, 1), ("c", "p3", 1.0, 0)]
    pairs = spark.createDataFrame(data, "query_id string, doc_id string, label double, retrieval_rank int")
    read = lambda o: [r["doc_id"] for r in o.orderBy("round", "block", "query_place", "side").collect()]
    plain, blocked = read(N.sampled_order(pairs)), read(N.sampled_order(pairs, blocked=True))
    assert sorted(plain[:4]) == ["n1", "n3", "p1", "p2"] and plain[0][0] == "p" and plain[1][0] == "n" and plain[4:] == ["p3", "n2"]
    assert sorted(blocked[:2]) == ["p1", "p2"] and sorted(blocked[2:4]) == ["n1", "n3"] and blocked[4:] == ["p3", "n2"]
    places = {e: sorted((r["query_place"], r["query_id"]) for r in N.sampled_order(pairs, epoch=e).collect()) for e in range(6)}
    assert len({tuple(dict.fromkeys(q for _, q in p)) for p in places.values()}) > 1
    groups = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "query_id string, positive string")
    assert [r["round"] for r in N.group_order(groups).orderBy("round", "query_place").collect()] == [1, 1, 2]
    made, queries = [], pairs.select("query_id").distinct()

    def make(q):
        made.append(1)
        return pairs.join(q, "query_id", "left_semi")

    path = str(tmp_path / "m")
    assert N.materialized(make, queries, path, 4).count() == 6 and len(made) == 4
    (tmp_path / "m" / "batch=2" / "_SUCCESS").unlink()
    assert rows(N.materialized(make, queries, path, 4).select(*pairs.columns)) == rows(pairs) and len(made) == 5
