import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import chunking as C


def joined(text, got):
    """The words of the pieces without what they repeat."""
    return [w for start, n, back, t in got for w in C._word.findall(t)[back:]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "ccc;", "1.", "d\n", "e f", "g ", "Điều 3\n"]), max_size=400), st.integers(8, 60))
def test_whole_bounded_and_overlapping(parts, limit):
    text, overlap = " ".join(parts), limit // 4
    got = C.pieces(text, limit, overlap, limit // 2)
    words = C._word.findall(text)
    assert joined(text, got) == words
    assert all(n <= limit for _, n, _, _ in got)
    assert all(back == overlap for _, _, back, _ in got[1:])
    for (s, n, _, t), (s2, _, back, t2) in zip(got, got[1:]):
        assert C._word.findall(t)[-back:] == C._word.findall(t2)[:back] if back else True
    if len(words) <= limit:
        assert got == [(0, len(words), 0, text)]


def sentences(n, seed=0):
    import random

    r = random.Random(seed)
    return [" ".join(r.choice("abcdefghij") * r.randint(1, 6) for _ in range(r.randint(6, 16))) + "." for _ in range(n)]


def test_pieces_end_at_sentences():
    text = " ".join(sentences(400))
    got = C.pieces(text)
    assert len(got) > 3 and all(t.endswith(".") for *_, t in got)


def test_an_edit_moves_only_the_cuts_beside_it():
    s = sentences(1500)
    ends = lambda text: {" ".join(t.split()[-12:]) for *_, t in C.pieces(text)}
    before = ends(" ".join(s))
    after = ends(" ".join([*s[:700], "một câu mới được thêm vào đây.", *s[700:]]))
    assert len(before) > 15 and len(before - after) <= 3


def test_no_boundaries_and_long_words():
    got = C.pieces(" ".join(["x"] * 5000))
    assert joined("", got) == ["x"] * 5000 and max(n for _, n, _, _ in got) <= 800
    assert C.pieces("y" * 100_000) == [(0, 1, 0, "y" * 100_000)]


def test_bad_overlap():
    with pytest.raises(ValueError):
        C.pieces("a", 10, 10)


def test_frame(spark):
    """Null, empty, blank, repeated and long rows, with a column whose name clashes."""
    long = " ".join(sentences(200))
    data = [("1", "d", None, "m"), ("2", "d", "", "m"), ("3", "d", "  ", "m"), ("4", "d", long, "m"), ("4", "d", long, "m"), ("5", None, "a b", "m"), (None, None, long, None)]
    df = spark.createDataFrame(data, "chunk_id string, article string, text string, n_words string")
    got = C.split_oversized(df, ["chunk_id"], "text", ["article"])
    by = {}
    for r in got.collect():
        by.setdefault(r["chunk_id"], []).append(r)
    assert sorted(map(str, by)) == ["2", "3", "4", "5", "None"]
    assert [(r["piece_no"], r["n_words"]) for r in by["2"] + by["3"]] == [(0, 0), (0, 0)]
    four = sorted(by["4"], key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in four] == list(range(len(four))) and joined("", [(r["start_word"], r["n_words"], r["n_repeated"], r["text"]) for r in four]) == long.split()
    big = C.split_oversized(df, ["chunk_id"], "text", ["article"], oversized_only=True)
    assert {r[0] for r in big.select("chunk_id").distinct().collect()} == {"4", None}
    assert C.split_oversized(df.limit(0), ["chunk_id"], "text").count() == 0
