import random

import numpy as np
import pytest

from siltstone.llm import neardup as N


def jaccard(a, b, k=3, weighted=False):
    from collections import Counter

    def grams(t):
        w = N._word.findall(t.lower())
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    a, b = grams(a), grams(b)
    if not weighted:
        a, b = Counter(set(a)), Counter(set(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


@pytest.mark.parametrize("weights", ["ones", "counts"])
def test_registers_estimate_weighted_similarity(weights):
    r = np.random.default_rng(3)
    errors = []
    for t in range(12):
        x, y = np.sort(r.choice(10**9, 300, replace=False)).astype(np.uint64), None
        keep = r.random(300) < 0.3 + 0.05 * t
        y = np.sort(np.concatenate([x[keep], r.choice(10**9, 300 - keep.sum()).astype(np.uint64) + np.uint64(2 * 10**9)]))
        wx, wy = (np.ones(300, int), np.ones(300, int)) if weights == "ones" else (r.integers(1, 30, 300), r.integers(1, 30, 300))
        a, b = dict(zip(x, wx)), dict(zip(y, wy))
        true = sum(min(a.get(e, 0), b.get(e, 0)) for e in a | b) / sum(max(a.get(e, 0), b.get(e, 0)) for e in a | b)
        s = N.signatures(np.array([300, 300]), np.concatenate([x, y]), np.concatenate([wx, wy]), 1024)
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.012 and max(map(abs, errors)) < 0.07


def corpus(n=60, seed=5):
    r = random.Random(seed)
    words = [f"từ{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.randint(25, 120))]
        out.append((f"{i}", " ".join(base)))
        for j in range(r.randint(0, 3)):
            edit = list(base)
            for _ in range(r.randint(0, 8)):
                edit[r.randrange(len(edit))] = r.choice(words)
            out.append((f"{i}_{j}", " ".join(edit)))
    return out


def test_links_against_all_pairs(spark):
    docs = corpus()
    link, members = N.links(spark.createDataFrame(docs, "id string, text string"), 3, 0.6, 20, False)
    got = {tuple(r) for r in N.pairs_of(link, members).collect()}
    want = {tuple(sorted((a, b))) for i, (a, x) in enumerate(docs) for b, y in docs[:i] if jaccard(x, y) >= 0.6}
    assert len(want) > 40 and got == want


def test_edges(spark):
    """Null and empty texts, short ones, nulls in ids, repeated rows, copies of one text, an id with two texts, clashing columns."""
    t = " ".join(f"w{i}" for i in range(30))
    u = " ".join(f"v{i}" for i in range(30))
    data = [("a", t, 1), ("b", t.upper() + "!", 1), ("b", t.upper() + "!", 1), ("c", None, 1), ("d", "", 1), ("e", "một hai", 1), (None, t, 1), ("f", t + " x", 1), ("g", u, 1), ("h", u, 1), ("h", t, 1)]
    df = spark.createDataFrame(data, "id string, text string, size int")
    link, members = N.links(df, 3, 0.6, 20, False)
    got = {tuple(r) for r in N.pairs_of(link, members).collect()}
    assert got == {("a", "b"), ("a", "f"), ("a", "h"), ("b", "f"), ("b", "h"), ("f", "h"), ("g", "h")}
    link, members = N.links(df.limit(0), 3, 0.6, 20, False)
    assert N.pairs_of(link, members).count() == 0 and N.groups(df.limit(0)).count() == 0


def test_weights_count(spark):
    a, b = "x y z w v " * 30, "x y z w v " * 10
    df = spark.createDataFrame([("a", a), ("b", b)], "id string, text string")
    assert N.links(df, 3, 0.9, 1, False)[0].count() + N.links(df, 3, 0.9, 1, False)[1].select("class_key").distinct().count() == 1
    assert N.links(df, 3, 0.9, 1, True)[0].count() == 0
    assert N.links(df, 3, 0.3, 1, True)[0].first()["similarity"] == pytest.approx(jaccard(a, b, 3, True))


def test_groups(spark):
    """A chain of edits is one group; a third of all rows are copies of one text."""
    base = [f"a{i}" for i in range(100)]
    edit = lambda k: " ".join(base[:k] + [f"b{i}" for i in range(k, k + 3)] + base[k + 3 :])
    data = [("0", " ".join(base)), ("1", edit(10)), ("2", edit(60)), ("z", " ".join(f"q{i}" for i in range(50)))] + [(f"c{i}", " ".join(base)) for i in range(200)]
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in N.groups(spark.createDataFrame(data, "id string, text string")).collect()}
    assert got["z"] == ("z", 0) and got["1"][0] == got["2"][0] == got["c7"][0] == "0"
    assert got["0"][1] == got["c9"][1] == 2 and got["1"][1] >= 201


def test_long_text(spark):
    t = " ".join(f"w{i % 5000}" for i in range(60_000))
    link, members = N.links(spark.createDataFrame([("a", t), ("b", t + " và thêm")], "id string, text string"), weighted=True)
    assert link.count() == 1 and members.count() == 2
