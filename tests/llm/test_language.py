import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import language as G
from siltstone.llm.bigru import BiGRU

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


@pytest.fixture(scope="module")
def samples():
    return [(r.lang, r.text) for r in pd.read_parquet(SAMPLES).sort_values("sample_id").itertuples()]


@pytest.fixture(scope="module")
def parts(samples):
    order = list(samples)
    random.Random(1).shuffle(order)
    return order[:140], order[140:]


@pytest.fixture(scope="module")
def tagger(parts):
    return G.Tagger(G.train(parts[0]))


def test_gradients():
    """Backpropagation through time against differences, both directions and both bytes of a step."""
    net = BiGRU(3, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(97, 103, (7, 4, 2)), r.integers(0, 3, (7, 4))
    loss, g = net.gradients(x, y)
    for k, v in net.p.items():
        for _ in range(6):
            i = tuple(int(r.integers(0, s)) for s in v.shape)
            if k.endswith("x"):
                i = (i[0], i[1], int(r.integers(97, 103)), i[3])
            keep = v[i]
            v[i] = keep + 1e-5
            up = net.gradients(x, y)[0]
            v[i] = keep - 1e-5
            down = net.gradients(x, y)[0]
            v[i] = keep
            assert abs((up - down) / 2e-5 - g[k][i]) < 1e-6 + 1e-4 * abs(g[k][i]), k


def test_windows_and_lanes(monkeypatch):
    """Windows score a text as one run over it does, wherever their edges fall; a stored network scores alike."""
    from siltstone.llm import bigru as N

    net = BiGRU(3, 8)
    r = np.random.default_rng(1)
    text = r.integers(97, 123, 2 * 900, dtype=np.uint8)
    starts, ends = np.array([0, 600, 604]), np.array([599, 602, 1800])
    monkeypatch.setattr(N, "WINDOW", 10_000)
    whole = net.scores(text, starts, ends)
    monkeypatch.setattr(N, "WINDOW", 64)
    monkeypatch.setattr(N, "CONTEXT", 64)
    monkeypatch.setattr(N, "LANES", 5)
    assert np.abs(BiGRU.loads(net.dumps()).scores(text, starts, ends) - whole).max() < 0.05 * np.abs(whole).max()
    x = text.reshape(-1, 2)[302:900]
    one = net._windows(np.stack([x @ np.array([256, 1]), x[::-1] @ np.array([256, 1]) + (1 << 16)], axis=1)[:, :, None].astype(np.int64))
    assert np.allclose(one[:, 0, 0] + one[::-1, 1, 0], whole[302:900], atol=1e-4)


def test_state_crosses_words(tagger):
    """A word that several languages share is read by its surroundings."""
    table, rows = tagger.words(["theo mẫu số kèm theo an toàn cho người lao động", "with an annual statement of the port office"])
    first, second = table[rows[0][5]], table[rows[1][1]]
    assert first[0] - first[1] > second[0] - second[1]


def test_held_out_accuracy(tagger, parts):
    got = tagger.segments([t for _, t in parts[1]])
    right = sum(len(s) == 1 and G.LANGUAGES[s[0][2]] == lang for (lang, _), s in zip(parts[1], got, strict=True))
    assert right / len(parts[1]) >= 0.95
    bare = [(lang, G.stripped(t)) for lang, t in parts[1] if lang == "vi"]
    got = tagger.segments([t for _, t in bare])
    assert sum(G.LANGUAGES[max(s, key=lambda x: x[1])[2]] == "vi" for s in got) / len(bare) >= 0.9


def test_mixed_texts(tagger, parts):
    """Two held-out texts in a row are two stretches whose border is found within a few words."""
    r, good, n = random.Random(3), 0, 0
    for _ in range(60):
        (a, x), (b, y) = r.sample(parts[1], 2)
        if a == b or min(len(x.split()), len(y.split())) < 15:
            continue
        s = tagger.segments([x + "\n" + y])[0]
        n += 1
        good += [G.LANGUAGES[k[2]] for k in s] == [a, b] and abs(s[0][1] - len(x.split())) <= 4
    assert n > 20 and good / n >= 0.85


@pytest.mark.parametrize("label, code", [("vi_VN", "vi"), (" VI ", "vi"), ("tiếng Việt", "vi"), ("Deutsch", "de"), ("en-GB", "en"), ("und", None), ("??", None), (None, None), ("", None), ("español", "es"), ("français", "fr"), ("n/a", None)])
def test_labels(spark, label, code):
    assert G.label_code(label) == code
    assert spark.createDataFrame([(label,)], "l string").select(G.code_of(F.col("l"))).first()[0] == code


def test_edges(spark, tagger):
    """Null, empty, numbers only, one long token, a long text, repeated rows and null ids."""
    vi = "Trường hợp tổ chức tín dụng không thu hồi văn bản ủy quyền theo chuẩn kỹ thuật vùng thì nộp phạt."
    data = [(1, None), (2, ""), (3, "12 345 6,7 - 8"), (4, "x" * 50_000), (5, vi * 3000), (6, vi), (6, vi), (None, vi), (7, "một")]
    got = G.tag(spark.createDataFrame(data, "doc_id long, text string").withColumn("segments", F.lit("clash")), "doc_id", "text", tagger.net).withColumn("held", G.held(None)).collect()
    by = {r["doc_key"]: r for r in got}
    assert len(got) == 9 and all(list(by[i]["held"]) == [] and by[i]["n_words"] == 0 for i in (1, 2, 3))
    assert list(by[5]["held"]) == list(by[6]["held"]) == list(by[None]["held"]) == ["vi"] and by[5]["n_words"] > 50_000
    assert all(0 <= s["confidence"] <= 1 for r in got for s in r["segments"])
    assert G.tag(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", tagger.net).count() == 0


def test_sample_is_bounded(spark, samples, monkeypatch):
    """The documents that train the network stay below twice the parameter."""
    seen = []

    def train(clean, labelled):
        seen.append((len(clean), len(labelled)))
        return BiGRU(5, 4)

    monkeypatch.setattr(G, "train", train)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("một hai").alias("text"), F.lit("vi").alias("lang"))
    one = G.trained(spark.read.parquet(SAMPLES), docs, "doc_id", "text", "lang", 200)
    G._nets.clear()
    again = G.trained(spark.read.parquet(SAMPLES), docs, "doc_id", "text", "lang", 200)
    assert len(seen) == 1 and all(np.array_equal(one.p[k], again.p[k]) for k in one.p)  # stored, not trained again
    assert seen[0][0] == 200 and 100 < seen[0][1] <= 400
