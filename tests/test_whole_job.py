"""Queries cover every row that they are about, not the search queries alone."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def of(spark, name, *cols):
    return [tuple(r) for r in E.queries()[name](spark, SF).select(*cols).collect()]


@pytest.mark.parametrize("name", ["e03_chunk_scores", "e04_selected", "e05_packs", "k02_shared_words", "k05_texts"])
def test_all_candidates_by_brute_force(spark, duck, name):
    """The SQL states the whole job, and queries far beyond the search set are answered."""
    want = duck.execute(E.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    plain = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    got = of(spark, name, *cols)
    assert plain(got) == plain(want.fetchall())
    asked = {r[cols.index("query_id")] for r in got}
    assert len(asked) > 5 * sum(int(q.lstrip("q")) % 50 == 0 for q in asked)


def test_evidence_of_every_candidate(spark):
    pairs = {r[:2] for r in of(spark, "e03_chunk_scores", "query_id", "doc_id")}
    for name in ("e04_selected", "e05_packs", "e07_lines", "k03_by_document"):
        assert set(of(spark, name, "query_id", "doc_id")) == pairs, name
    assert {r[0] for r in of(spark, "k04_reranked", "query_id")} >= {q for q, _ in pairs}


def test_positive_of_every_judgement(spark, duck):
    from siltstone.sources import canonical as C

    macro = {r[0] for r in C.chunks(spark, SF).filter("granularity = 'macro'").select("doc_id").collect()}
    asked = {r[0] for r in C.questions(spark, SF).select("query_id").collect()}
    want = {(r["query_id"], r["doc_id"]) for r in C.relevant(spark, SF).collect() if r["query_id"] in asked and r["doc_id"] in macro}
    assert len(want) > 10 and set(of(spark, "e08_positives", "query_id", "doc_id")) == want
    assert of(spark, "k08_table", "n_queries")[0][0] > 10


def test_pairs_have_the_evidence_of_their_question(spark):
    rows = of(spark, "s_p12_pairs", "query_id", "doc_id", "label", "evidence_chunk_ids", "evidence_text")
    best = {r[:2]: r[2] for r in of(spark, "e08_positives", "query_id", "doc_id", "chunk_id")}
    positive = [r for r in rows if r[2] > 0.5]
    assert positive and len(rows) > len(positive)
    assert all(r[3] == best.get(r[:2], "") for r in positive)
    assert all(r[4].startswith("[DOCUMENT] ") and "[EVIDENCE 1] " in r[4] for r in rows)
    # One document has different evidence for different questions.
    by = {}
    for r in rows:
        by.setdefault(r[1], set()).add(r[4])
    assert any(len(x) > 1 for x in by.values())
