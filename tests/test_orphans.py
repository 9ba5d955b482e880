from datetime import datetime as D

import pytest

from siltstone.operators import orphans as O

T = [D(2024, m, 1) for m in range(1, 8)]


@pytest.fixture
def parts(spark):
    def make(refs, docs):
        r = spark.createDataFrame(refs, "chunk_id string, document_id string, loaded_at timestamp_ntz, key string, refs int")
        t = spark.createDataFrame(docs, "doc_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, target string")
        return [O.Reference("chunks", "document_id", "chunk_id", "docs", r)], [O.Target("docs", "doc_id", t)]

    return make


def test_kinds(parts, rows):
    """Every kind, ids that name nothing, padding, repeated deliveries, missing times, columns of clashing names."""
    refs = [
        ("a", "1", T[3], "k", 1), ("b", " 1 ", T[0], "k", 1), ("c", "2", T[3], "k", 1), ("c", "2", T[3], "k", 1), ("c", "2", T[1], "k", 1), ("d", "9", T[3], "k", 1), ("e", None, T[3], "k", 1),
        ("f", "NaN", T[3], "k", 1), ("g", "  ", T[3], "k", 1), ("h", "9", None, "k", 1), ("i", "1", None, "k", 1), ("j", "3", T[2], "k", 1), (None, "9", T[3], "k", 1),
    ]
    docs = [("1", T[1], None, "x"), ("1", T[2], None, "x"), ("2", T[0], T[3], "x"), ("3", T[2], T[5], "x"), (None, T[0], None, "x")]
    got = rows(O.broken_references(*parts(refs, docs)))
    want = [("b", "2024-01", "late"), ("c", "2024-04", "deleted"), ("d", "2024-04", "missing"), ("h", None, "missing"), (None, "2024-04", "missing")]
    assert got == sorted([("chunks", "document_id", *w) for w in want], key=repr)


def test_hot_key(parts, spark):
    """A third of all rows on one broken key: every row is reported."""
    refs = [(str(i), "hot" if i % 3 == 0 else str(i), T[2], None, None) for i in range(3000)]
    got = O.broken_references(*parts(refs, [(str(i), T[0], None, None) for i in range(3000)]))
    assert got.count() == 1000
    assert [tuple(r)[4:] for r in O.orphan_report(got).collect()] == [(1000,)]


def test_state_merges_like_one_batch(parts, rows):
    refs = [(str(i), str(i % 7), T[i % 5], None, None) for i in range(40)]
    docs = [(str(i), T[i % 3], T[4] if i % 2 else None, None) for i in range(5)]
    whole = O.merge_state(O.reference_deltas(parts(refs, docs)[0]), O.existence_deltas(parts(refs, docs)[1]))
    a, b = parts(refs[:15], docs[:2]), parts(refs[15:], docs[2:])
    first = O.merge_state(O.reference_deltas(a[0]), O.existence_deltas(a[1]))
    both = O.merge_state(first, O.reference_deltas(b[0]), O.existence_deltas(b[1]))
    assert rows(both) == rows(whole)
    assert {r["key"]: r["kind"] for r in O.orphan_keys(both).collect()} == {"1": "deleted", "3": "deleted", "5": "missing", "6": "missing"}
    gone = O.merge_state(both, O.reference_deltas(parts([r for r in refs if r[1] == "5"], docs)[0], sign=-1))
    assert "5" not in {r["key"] for r in O.orphan_keys(gone).collect()}


def test_withdrawn_and_loaded_again(parts, spark, rows):
    """Withdrawn on day 3 and loaded again on day 5: an orphan between, none afterwards; a late copy of the withdrawn delivery changes nothing."""
    refs = [("a", "1", T[1], None, None), ("b", "1", T[3], None, None), ("c", "1", T[6], None, None), ("d", "1", T[0], None, None)]
    docs = [("1", T[1], T[2], None), ("1", T[4], None, None)]
    r, t = parts(refs, docs)
    assert rows(O.broken_references(r, t)) == [("chunks", "document_id", "b", "2024-04", "deleted"), ("chunks", "document_id", "d", "2024-01", "late")]
    state = O.merge_state(O.reference_deltas(r), O.existence_deltas(t))
    assert O.orphan_keys(state).count() == 0
    r, t = parts(refs, [("1", T[1], T[2], None), ("1", T[4], T[2], None)])
    assert {x["row_key"]: x["kind"] for x in O.broken_references(r, t).collect()} == {"b": "deleted", "c": "deleted", "d": "late"}


def test_take_back_and_restore(parts, rows):
    """A batch of deliveries and one of references taken back leave no trace; loading again restores."""
    refs, docs = [("a", "1", T[3], None, None), ("b", "2", T[3], None, None)], [("1", T[0], None, None), ("2", T[0], None, None)]
    r, t = parts(refs, docs)
    state = O.merge_state(O.reference_deltas(r), O.existence_deltas(t))
    _, one = parts(refs, docs[:1])
    back = O.merge_state(state, O.existence_deltas(one, sign=-1))
    assert rows(O.orphan_keys(back)) == [("docs", "1", 1, "missing")]
    assert rows(O.merge_state(back, O.existence_deltas(one))) == rows(state)
    first, _ = parts(refs[:1], docs)
    less = O.merge_state(back, O.reference_deltas(first, sign=-1))
    assert O.orphan_keys(less).count() == 0 and O.current(less).filter("key = '1'").count() == 0
    again = O.merge_state(less, O.reference_deltas(first))
    assert rows(O.orphan_keys(again)) == [("docs", "1", 1, "missing")]
    assert rows(O.broken_references(r, parts(refs, docs[1:])[1], again)) == [("chunks", "document_id", "a", "2024-04", "missing")]


def test_empty(parts):
    assert O.broken_references(*parts([], [])).count() == 0
    assert O.broken_references(*parts([("a", "1", T[0], None, None)], [])).first()["kind"] == "missing"
