"""Queries on measures, validation, folds and training pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evidence as E
from siltstone.operators import metrics as M
from siltstone.operators import pairs as N
from siltstone.operators import ranking as R
from siltstone.operators import splits as S
from siltstone.plans import evidence as V
from siltstone.plans import sqlparts as P
from siltstone.plans.retrieval import _FUSED, ranks_sql
from siltstone.sources import canonical as C
from siltstone.sources.tables import table
from siltstone.storage import cut, new_path


def _answers(s, d):
    f = V._fused(s, d, 5)
    return f.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("answer"))


def _pool(s, d):
    return V._fused(s, d, 200)


def v02_per_query(s, d):
    m = M.per_query(_answers(s, d), C.relevant(s, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


def v02_means(s, d):
    m = M.means(M.per_query(_answers(s, d), C.relevant(s, d)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns if c != "n_queries"], "n_queries")


def v01_official(s, d):
    rel = C.relevant(s, d)
    a = rel.select("query_id").distinct().join(_answers(s, d), "query_id", "left")
    return M.official(a, rel).select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def v03_candidate_recall(s, d):
    return M.candidate_recall(_pool(s, d), C.relevant(s, d)).select("cutoff", F.round("recall", 6).alias("recall"), F.round("any_hit", 6).alias("any_hit"), "n_queries")


def v04_ceilings(s, d):
    return M.ceilings(_pool(s, d), C.relevant(s, d)).select(F.round("ceiling", 6).alias("ceiling"), F.round("oracle", 6).alias("oracle"), "n_queries")


def v05_misses(s, d):
    return M.misses(_pool(s, d), C.relevant(s, d), 50)


def v06_ranking_measures(s, d):
    m = M.ranking_measures(_pool(s, d).select("query_id", "doc_id", "rank"), C.relevant(s, d), 10)
    return m.select(*[F.round(c, 6).alias(c) for c in ("recall", "mrr", "hit1", "ndcg")], "n_queries")


def v08_over_folds(s, d):
    folds = S.bucket_folds(C.questions(s, d).select("query_id"))
    per = M.per_query(_answers(s, d), C.relevant(s, d)).join(folds, "query_id")
    names = ["recall", "precision", "mrr", "map", "ndcg_at_5"]
    return M.over_folds(M.means(per, ["fold"]), names).select("measure", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def _tables(s, d):
    docs = table(s, d, "legal_docs")
    chunks = table(s, d, "chunks").withColumn("doc_id", F.col("document_id"))
    qrels = table(s, d, "qrels").select("query_id", F.col("document_id").alias("doc_id"), "relevance")
    return docs, chunks, table(s, d, "queries_train"), qrels


def v10_violations(s, d):
    return M.violations(*_tables(s, d))


def v11_renamed(s, d):
    """The checks on tables whose columns have other names; a table that lacks a column says so instead."""
    docs, chunks, queries, qrels = (table(s, d, t) for t in ("legal_docs", "chunks", "queries_train", "qrels"))
    return M.validated(docs, chunks.withColumnRenamed("granularity", "chunk_level"), queries.withColumnRenamed("query_id", "qid").withColumnRenamed("gold_count", "num_gold"), qrels)


def v11_missing(s, d):
    return M.validated(table(s, d, "legal_docs"), table(s, d, "macro_chunks"), table(s, d, "queries_train").drop("gold_count"), table(s, d, "qrels"))


def v12_answer_errors(s, d):
    a = _answers(s, d)
    return M.answer_errors(a, C.questions(s, d), C.docs(s, d))


def v19_cardinalities(s, d):
    return M.cardinalities(*_tables(s, d))


def v15_coverage(s, d):
    """Queries that the pooled folds lack or have too much."""
    folds = S.bucket_folds(C.questions(s, d).select("query_id"))
    a = _answers(s, d).join(folds, "query_id")
    return M.answer_errors(a.select("query_id", "answer"), C.questions(s, d)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def s_p01_buckets(s, d):
    return S.bucket_folds(C.questions(s, d).select("query_id"))


def s_p01_shuffled(s, d):
    return S.random_folds(C.questions(s, d).select("query_id"))


def s_p02_components(s, d):
    return S.question_components(C.relevant(s, d))


def s_p02_disjoint(s, d):
    return S.document_disjoint(C.relevant(s, d))


def s_p03_fold_checks(s, d):
    return S.fold_violations(S.bucket_folds(C.questions(s, d).select("query_id")), C.questions(s, d).select("query_id"), C.relevant(s, d))


def s_p04_disjoint_checks(s, d):
    t = table(s, d, "doc_disjoint_split")
    sides = t.select(F.explode("train_qids").alias("query_id"), F.lit("train").alias("side")).union(t.select(F.explode("val_qids"), F.lit("val"))).dropna()
    return S.disjoint_violations(sides, C.relevant(s, d))


def s_p06_overlap(s, d):
    t = table(s, d, "doc_disjoint_split")
    return S.overlap(t.select(F.explode("train_qids").alias("query_id")), t.select(F.explode("val_qids").alias("query_id")))


def _ranks(s, d):
    return R.branch_ranks(table(s, d, "static_candidates"), 80)


def _banned(s, d, candidates):
    x = C.docs(s, d).filter("document_text is not null and document_text != ''").select(F.sha2("document_text", 256).alias("group_id"), "doc_id")
    return N.blacklist(candidates, C.relevant(s, d), x)


def _mined(s, d):
    fused = V._fused(s, d, 80).withColumnRenamed("rrf_score", "score")
    return N.bands_of(fused.select("query_id", "doc_id", "rank", "score"), _ranks(s, d))


def s_p08_flat(s, d):
    c = V._fused(s, d, 80).select("query_id", "doc_id", "rank")
    return N.flat(c, _banned(s, d, c), 10).select("query_id", "doc_id", "n", "band")


def s_p09_by_source(s, d):
    c = cut(_mined(s, d), "mined")
    got = N.by_source(c, _banned(s, d, c))
    return got.select("query_id", "n", "doc_id", "source", "rank", "band")


def s_p10_by_band(s, d):
    c = cut(_mined(s, d), "mined")
    return N.by_band(c, _banned(s, d, c)).select("query_id", "n", "doc_id", "source", "rank", "band")


def s_p11_bands(s, d):
    return _mined(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"))


def _evidence(s, d, pairs):
    """Pack of the three best chunks and the id of the chunk that answers the question, by pair; without chunks the pack names the document."""
    q, m = V._questions(s, d), V._macros(s, d)
    chosen = E.selected(E.scored_chunks(pairs, q, m), 3)
    texts = E.packs(pairs.join(chosen, ["query_id", "doc_id"], "left"), C.docs(s, d)).select("query_id", "doc_id", F.col("pack").alias("evidence_text"))
    one = E.selected(E.scored_chunks(pairs, q, m, training=True), 1, skip_empty=False)
    ids = one.select("query_id", "doc_id", F.transform("chunks", lambda x: x["chunk_id"]).alias("evidence_chunk_ids"))
    return texts.join(ids, ["query_id", "doc_id"], "left").withColumn("evidence_chunk_ids", F.coalesce("evidence_chunk_ids", F.array().cast("array<string>")))


def _pairs(s, d, evidence=False):
    rel = C.relevant(s, d).join(C.docs(s, d).select("doc_id"), "doc_id", "left_semi")
    c = cut(_mined(s, d), "mined")
    neg = cut(N.by_source(c, _banned(s, d, c), most=12), "negatives")
    both = rel.select("query_id", "doc_id").union(neg.select("query_id", "doc_id")).distinct()
    # Coverage, order and groups show no evidence and build none.
    both = _evidence(s, d, cut(both, "pairs")) if evidence else both.select("*", F.lit(None).cast("array<string>").alias("evidence_chunk_ids"), F.lit(None).cast("string").alias("evidence_text"))
    q = C.questions(s, d).select("query_id", F.col("question_raw").alias("question"))
    return N.reranker_pairs(rel, neg, both, q, S.bucket_folds(q.select("query_id")))


def s_p12_pairs(s, d):
    return _pairs(s, d, evidence=True).select("query_id", "doc_id", "label", "negative_source", "retrieval_rank", "fold", F.array_join("evidence_chunk_ids", ",").alias("evidence_chunk_ids"), "evidence_text")


def s_p12_triples(s, d):
    c = cut(_mined(s, d), "mined")
    neg = N.by_source(c, _banned(s, d, c), most=12)
    return N.retriever_triples(C.relevant(s, d), neg).select("query_id", "pos_doc_id", "neg_doc_id", "neg_n")


def s_p14_coverage(s, d):
    return N.coverage(_pairs(s, d), C.questions(s, d))


def s_p15_order(s, d):
    o = N.balanced_order(_pairs(s, d))
    return o.select("query_id", "doc_id", "side", "round", "query_place")


def s_p16_groups(s, d):
    return N.listwise_groups(_pairs(s, d)).select("query_id", "positive", F.array_join("negatives", ",").alias("negatives"))


def s_p19_subset(s, d):
    _, docs = S.subset(C.questions(s, d), C.relevant(s, d), C.docs(s, d), 50, 120)
    return docs


def s_p20_splits(s, d):
    """Both divisions made, stored and checked."""
    q = C.questions(s, d).join(C.relevant(s, d).select("query_id"), "query_id", "left_semi").select("query_id")
    rel = C.relevant(s, d).join(q, "query_id", "left_semi")
    return s.createDataFrame(sorted(S.write_splits(q, rel, new_path(s, "splits")).items()), "check_name string, n long")


def j15_classes(s, d):
    x = C.docs(s, d).filter("legal_number is not null and trim(legal_number) != ''").select(F.lower(F.trim("legal_number")).alias("group_id"), "doc_id")
    return N.classes(x)


QUERIES = {
    "v01_official": v01_official, "v02_per_query": v02_per_query, "v02_means": v02_means, "v03_candidate_recall": v03_candidate_recall, "v04_ceilings": v04_ceilings, "v05_misses": v05_misses, "v06_ranking_measures": v06_ranking_measures,
    "v08_over_folds": v08_over_folds, "v10_violations": v10_violations, "v11_renamed": v11_renamed, "v11_missing": v11_missing, "v12_answer_errors": v12_answer_errors, "v15_coverage": v15_coverage, "v19_cardinalities": v19_cardinalities,
    "s_p01_buckets": s_p01_buckets, "s_p01_shuffled": s_p01_shuffled, "s_p02_components": s_p02_components, "s_p02_disjoint": s_p02_disjoint, "s_p03_fold_checks": s_p03_fold_checks, "s_p04_disjoint_checks": s_p04_disjoint_checks,
    "s_p06_overlap": s_p06_overlap, "s_p08_flat": s_p08_flat, "s_p09_by_source": s_p09_by_source, "s_p10_by_band": s_p10_by_band, "s_p11_bands": s_p11_bands, "s_p12_pairs": s_p12_pairs, "s_p12_triples": s_p12_triples,
    "s_p14_coverage": s_p14_coverage, "s_p15_order": s_p15_order, "s_p16_groups": s_p16_groups, "s_p19_subset": s_p19_subset, "s_p20_splits": s_p20_splits, "j15_classes": j15_classes,
}


def _top(k: int) -> str:
    return f"""{ranks_sql(V.DEPTH)}, {', '.join(f'{n} AS MATERIALIZED ({P.LAST[n]})' for n in ('docs', 'qs', 'rels'))}, {_FUSED},
      top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM fused) WHERE rank <= {k})"""


_PQ = f"""{_top(5)}, gold AS (SELECT query_id, count(*) AS g FROM rels GROUP BY ALL), len AS (SELECT query_id, count(*) AS n FROM top GROUP BY ALL),
  hit AS (SELECT t.query_id, t.rank, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank) AS h FROM top t JOIN rels r ON r.query_id = t.query_id AND r.doc_id = t.doc_id),
  pq AS (SELECT g.query_id, g, n, count(h.rank) AS h5, count(h.rank) FILTER (h.rank <= 1) AS h1, count(h.rank) FILTER (h.rank <= 3) AS h3, coalesce(1.0 / min(h.rank), 0) AS mrr, coalesce(sum(h * 1.0 / h.rank), 0) / g AS map,
    coalesce(sum(1 / log2(h.rank + 1)), 0) / list_sum(list_transform(range(1, least(g, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_5
    FROM gold g LEFT JOIN len l USING (query_id) LEFT JOIN hit h ON h.query_id = g.query_id GROUP BY g.query_id, g, n),
  m AS (SELECT query_id, h5 / g::DOUBLE AS recall, coalesce(h5 / n::DOUBLE, 0) AS precision, h1 / g::DOUBLE AS recall_at_1, h3 / g::DOUBLE AS recall_at_3, h5 / g::DOUBLE AS recall_at_5, coalesce(h1 / least(n, 1)::DOUBLE, 0) AS precision_at_1,
    coalesce(h3 / least(n, 3)::DOUBLE, 0) AS precision_at_3, coalesce(h5 / n::DOUBLE, 0) AS precision_at_5, mrr, map, ndcg_at_5 FROM pq)"""
_MEASURES = ["recall", "precision", "recall_at_1", "precision_at_1", "recall_at_3", "precision_at_3", "recall_at_5", "precision_at_5", "mrr", "map", "ndcg_at_5"]
_HITS = f"{_top(200)}, gold AS (SELECT query_id, count(*) AS g FROM rels GROUP BY ALL), hr AS (SELECT r.query_id, t.rank FROM rels r JOIN top t ON t.query_id = r.query_id AND t.doc_id = r.doc_id)"
_V = lambda name, q: f"SELECT '{name}' AS check_name, (SELECT count(*) FROM ({q})) AS n"
_REP = lambda t, k: f"SELECT {k} FROM {t} GROUP BY {k} HAVING count(*) > 1"
_MACRO = "(SELECT DISTINCT chunk_id, document_id FROM chunks WHERE granularity = 'macro')"
_MINED = f"""{ranks_sql(V.DEPTH)}, {', '.join(f'{n} AS MATERIALIZED ({P.LAST[n]})' for n in ('docs', 'qs', 'rels'))}, {_FUSED},
  top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM fused) WHERE rank <= 80),
  mined AS MATERIALIZED (SELECT query_id, branch AS source, doc_id, rank FROM ranks WHERE rank <= 30 UNION ALL SELECT query_id, 'hybrid', doc_id, rank FROM top WHERE rank <= 30
    UNION ALL SELECT query_id, 'near_miss', doc_id, rank FROM top WHERE rank BETWEEN 3 AND 15 UNION ALL SELECT query_id, 'medium_neg', doc_id, rank FROM top WHERE rank BETWEEN 21 AND 80),
  grp AS (SELECT sha256(document_text) AS group_id, doc_id FROM docs WHERE document_text IS NOT NULL AND document_text <> ''),
  banned AS MATERIALIZED (SELECT query_id, doc_id FROM rels UNION SELECT r.query_id, o.doc_id FROM rels r JOIN grp g ON g.doc_id = r.doc_id JOIN grp o ON o.group_id = g.group_id)"""
_BAND = "CASE WHEN rank <= 5 THEN 'very_hard' WHEN rank <= 20 THEN 'hard' ELSE 'medium' END"
_PLACE = "CASE source " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(N.QUOTAS)) + f" ELSE {len(N.QUOTAS)} END"


def _quota(column: str, quotas: dict, default: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in quotas.items()) + f" ELSE {default} END"


def _fold_sql(kind: str, order: str, quotas: dict, default: int, most: int) -> str:
    """``neg``: rows taken in order unless their document, their kind's quota or the total is full, by a walk over each query's rows."""
    take = f"NOT list_contains(w.docs, o.doc_id) AND len(list_filter(w.kinds, lambda x: x = o.{kind})) < {_quota(f'o.{kind}', quotas, default)} AND len(w.docs) < {most}"
    return f"""{_MINED.replace('WITH', 'WITH RECURSIVE', 1)},
  okay AS (SELECT *, {_BAND} AS band FROM mined m WHERE doc_id <> '' AND NOT EXISTS (SELECT 1 FROM banned b WHERE b.query_id = m.query_id AND b.doc_id = m.doc_id)),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS i FROM okay),
  w AS (SELECT DISTINCT query_id, 0::BIGINT AS i, []::VARCHAR[] AS docs, []::VARCHAR[] AS kinds, []::BIGINT[] AS got FROM o
    UNION ALL SELECT w.query_id, o.i, CASE WHEN {take} THEN list_append(w.docs, o.doc_id) ELSE w.docs END, CASE WHEN {take} THEN list_append(w.kinds, o.{kind}) ELSE w.kinds END, CASE WHEN {take} THEN list_append(w.got, o.i) ELSE w.got END FROM w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1),
  neg AS MATERIALIZED (SELECT o.query_id, list_position(got, o.i) AS n, o.doc_id, source, rank, band FROM (SELECT query_id, max_by(got, i) AS got FROM w GROUP BY query_id) l JOIN o ON o.query_id = l.query_id AND list_contains(got, o.i))"""


_NEG12 = _fold_sql("source", f"{_PLACE}, source, rank, doc_id", N.QUOTAS, 3, 12)
_PAIRS = f"""{_NEG12}, pp AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, 1.0 AS label, 0 AS retrieval_rank FROM rels WHERE doc_id IN (SELECT doc_id FROM docs) UNION ALL SELECT query_id, doc_id, 0.0, rank FROM neg) WHERE query_id IN (SELECT query_id FROM qs))"""
_RUN = lambda key: f"md5('42:' || {key})"
_DISJOINT = f"""{P.with_tables('rels').replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT DISTINCT a.query_id AS a, b.query_id AS b FROM rels a JOIN rels b USING (doc_id)), r AS (SELECT DISTINCT query_id AS root, query_id FROM rels UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.query_id),
  cp AS (SELECT query_id, min(root) AS component FROM r GROUP BY query_id), sz AS (SELECT component, count(*) AS n FROM cp GROUP BY component), ru AS (SELECT *, sum(n) OVER (ORDER BY {_RUN('component')}) AS upto, sum(n) OVER () AS everything FROM sz)"""
SQL = {
    "v01_official": f"{_PQ} SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM m",
    "v02_per_query": f"{_PQ} SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURES) + " FROM m",
    "v02_means": f"{_PQ} SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEASURES) + ", count(*) AS n_queries FROM m",
    "v03_candidate_recall": f"""{_HITS} SELECT cutoff, round(avg(r), 6) AS recall, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS any_hit, count(*) AS n_queries FROM (SELECT g.query_id, cutoff, count(h.rank) FILTER (h.rank <= cutoff) / g::DOUBLE AS r
      FROM gold g CROSS JOIN (SELECT unnest([20, 50, 100, 150, 200]) AS cutoff) LEFT JOIN hr h ON h.query_id = g.query_id GROUP BY g.query_id, g, cutoff) GROUP BY cutoff""",
    "v04_ceilings": f"{_HITS}, p AS (SELECT query_id, count(*) AS p FROM hr GROUP BY ALL) SELECT round(avg(least(g, 5) / g::DOUBLE), 6) AS ceiling, round(avg(least(coalesce(p, 0), 5) / g::DOUBLE), 6) AS oracle, count(*) AS n_queries FROM gold LEFT JOIN p USING (query_id)",
    "v05_misses": f"{_HITS} SELECT query_id FROM gold WHERE query_id NOT IN (SELECT query_id FROM hr WHERE rank <= 50)",
    "v06_ranking_measures": f"""{_HITS}, k AS (SELECT g.query_id, g, count(h.rank) AS n, min(h.rank) AS f, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg FROM gold g LEFT JOIN (SELECT * FROM hr WHERE rank <= 10) h ON h.query_id = g.query_id GROUP BY g.query_id, g)
      SELECT round(avg(n / g::DOUBLE), 6) AS recall, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CASE WHEN f = 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(dcg / list_sum(list_transform(range(1, least(g, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, count(*) AS n_queries FROM k""",
    "v08_over_folds": f"""{_PQ}, fm AS (SELECT {V._FOLD} AS fold, {", ".join(f"avg({c}) AS {c}" for c in ("recall", "precision", "mrr", "map", "ndcg_at_5"))} FROM m WHERE query_id IN (SELECT query_id FROM qs) GROUP BY ALL),
      u AS (UNPIVOT fm ON recall, precision, mrr, map, ndcg_at_5 INTO NAME measure VALUE v) SELECT measure, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM u GROUP BY measure""",
    "v10_violations": " UNION ALL ".join([
        _V("repeated document", _REP("legal_docs", "doc_id")), _V("repeated chunk", _REP("chunks", "chunk_id")), _V("unknown granularity", "SELECT 1 FROM chunks WHERE granularity IS NULL OR granularity NOT IN ('macro', 'micro')"),
        _V("chunk of unknown document", "SELECT DISTINCT document_id FROM chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT doc_id FROM legal_docs)"),
        _V("document without chunks", "SELECT DISTINCT doc_id FROM legal_docs WHERE NOT is_empty AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = doc_id)"),
        _V("missing parent", f"SELECT DISTINCT parent_chunk_id FROM chunks WHERE granularity = 'micro' AND parent_chunk_id IS NOT NULL AND parent_chunk_id NOT IN (SELECT chunk_id FROM {_MACRO})"),
        _V("parent in another document", f"SELECT 1 FROM chunks c JOIN {_MACRO} m ON m.chunk_id = c.parent_chunk_id WHERE granularity = 'micro' AND m.document_id <> c.document_id"),
        _V("repeated query", _REP("queries_train", "query_id")), _V("repeated judgement", _REP("qrels", "query_id, document_id")),
        _V("judgement of unknown query", "SELECT DISTINCT query_id FROM qrels r WHERE NOT EXISTS (SELECT 1 FROM queries_train q WHERE q.query_id = r.query_id)"),
        _V("judgement of unknown document", "SELECT DISTINCT document_id FROM qrels r WHERE NOT EXISTS (SELECT 1 FROM legal_docs q WHERE q.doc_id = r.document_id)"),
        _V("relevance other than 1", "SELECT 1 FROM qrels WHERE relevance IS NULL OR relevance <> 1"),
        _V("wrong gold count", "SELECT 1 FROM queries_train q LEFT JOIN (SELECT query_id, count(*) AS c FROM qrels GROUP BY ALL) g USING (query_id) WHERE gold_count IS NOT NULL AND gold_count <> coalesce(c, 0)"),
    ]),
    "v12_answer_errors": f"""{_top(5)} SELECT DISTINCT query_id, 'unknown document' AS error FROM top WHERE doc_id NOT IN (SELECT doc_id FROM docs) UNION ALL SELECT query_id, 'missing query' FROM qs WHERE query_id NOT IN (SELECT query_id FROM top)
      UNION ALL SELECT DISTINCT query_id, 'extra query' FROM top WHERE query_id NOT IN (SELECT query_id FROM qs)""",
    "v15_coverage": f"{_top(5)} SELECT 'missing query' AS error, count(*) AS n FROM qs WHERE query_id NOT IN (SELECT query_id FROM top) HAVING count(*) > 0",
    "v19_cardinalities": " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM {t}" for k, t in (("documents", "legal_docs"), ("empty documents", "legal_docs WHERE is_empty"), ("chunks", "chunks"), ("macro chunks", "chunks WHERE granularity = 'macro'"), ("micro chunks", "chunks WHERE granularity = 'micro'"), ("queries", "queries_train"), ("judgements", "qrels"))),
    "s_p01_buckets": f"{P.with_tables('qs')} SELECT query_id, {V._FOLD} AS fold FROM qs",
    "s_p02_components": f"""{P.with_tables('rels').replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT DISTINCT a.query_id AS a, b.query_id AS b FROM rels a JOIN rels b USING (doc_id)), r AS (SELECT DISTINCT query_id AS root, query_id FROM rels UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.query_id)
      SELECT query_id, min(root) AS component FROM r GROUP BY query_id""",
    "s_p03_fold_checks": f"""{P.with_tables('qs', 'rels')} SELECT 'fewer than two folds' AS check_name, CASE WHEN count(DISTINCT {V._FOLD}) < 2 THEN 1 ELSE 0 END AS n FROM qs UNION ALL SELECT 'query in several folds', 0 UNION ALL SELECT 'query without fold', 0 UNION ALL SELECT 'fold query unknown', 0
      UNION ALL SELECT 'fold query without relevant document', count(*) FROM qs WHERE query_id NOT IN (SELECT query_id FROM rels)""",
    "s_p04_disjoint_checks": f"""{P.with_tables('rels')}, sd AS (SELECT DISTINCT * FROM (SELECT unnest(train_qids) AS query_id, 'train' AS side FROM doc_disjoint_split UNION ALL SELECT unnest(val_qids), 'val' FROM doc_disjoint_split) WHERE query_id IS NOT NULL)
      SELECT 'query on both sides' AS check_name, (SELECT count(*) FROM (SELECT query_id FROM sd GROUP BY ALL HAVING count(*) > 1)) AS n UNION ALL SELECT 'relevant document on both sides', (SELECT count(*) FROM (SELECT doc_id FROM rels JOIN sd USING (query_id) GROUP BY ALL HAVING count(DISTINCT side) > 1))""",
    "s_p06_overlap": "SELECT DISTINCT a AS query_id FROM (SELECT unnest(train_qids) AS a FROM doc_disjoint_split) WHERE a IN (SELECT unnest(val_qids) FROM doc_disjoint_split)",
    "s_p08_flat": f"""{_MINED} SELECT query_id, doc_id, n, CASE WHEN rank <= 5 THEN 'very_hard' WHEN rank <= 20 THEN 'hard' ELSE 'medium' END AS band FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS n FROM top t WHERE NOT EXISTS (SELECT 1 FROM banned b WHERE b.query_id = t.query_id AND b.doc_id = t.doc_id)) WHERE n <= 10""",
    "s_p11_bands": f"{_MINED} SELECT source, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM mined GROUP BY source",
    "j15_classes": f"{P.with_tables('docs')}, g AS (SELECT DISTINCT lower(trim(legal_number)) AS k, doc_id FROM docs WHERE trim(legal_number) <> '') SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n_members FROM g",
    "s_p01_shuffled": f"""{P.with_tables('qs')}, o AS (SELECT query_id, row_number() OVER (ORDER BY {_RUN('query_id')}) - 1 AS before, count(*) OVER () AS n FROM qs)
      SELECT query_id, least(before // greatest(1, n // greatest(2, least(5, n))), greatest(2, least(5, n)) - 1)::INT AS fold FROM o""",
    "s_p02_disjoint": f"{_DISJOINT} SELECT query_id, component, CASE WHEN upto <= floor(everything * 0.2) OR upto = n THEN 'val' ELSE 'train' END AS side FROM cp JOIN ru USING (component)",
    "s_p09_by_source": f"{_fold_sql('source', f'{_PLACE}, source, rank, doc_id', N.QUOTAS, 3, 15)} SELECT query_id, n, doc_id, source, rank, band FROM neg",
    "s_p10_by_band": f"{_fold_sql('band', f'{_quota("band", {k: i for i, k in enumerate(N.BANDS)}, len(N.BANDS))}, {_PLACE}, source, rank, doc_id', N.BANDS, 5, 15)} SELECT query_id, n, doc_id, source, rank, band FROM neg",
    "s_p12_triples": f"{_NEG12} SELECT r.query_id, r.doc_id AS pos_doc_id, neg.doc_id AS neg_doc_id, n AS neg_n FROM rels r JOIN neg ON neg.query_id = r.query_id",
    "s_p14_coverage": f"""{_PAIRS}, h AS (SELECT query_id, max((label > 0.5)::INT) AS p, max((label <= 0.5)::INT) AS n FROM pp GROUP BY ALL), e AS (SELECT q.query_id, p, coalesce(p, 0) AS cp, coalesce(n, 0) AS cn FROM qs q LEFT JOIN h USING (query_id))
      SELECT count(*) AS expected, count(p) AS in_pairs, sum(cp)::BIGINT AS with_positive, sum(cn)::BIGINT AS with_negative, sum(cp * cn)::BIGINT AS eligible, round(100.0 * sum(cp) / count(*), 2) AS positive_pct, round(100.0 * sum(cn) / count(*), 2) AS negative_pct, round(100.0 * sum(cp * cn) / count(*), 2) AS eligible_pct FROM e""",
    "s_p15_order": f"""{_PAIRS}, sd AS (SELECT *, CASE WHEN label > 0.5 THEN 0 ELSE 1 END AS side FROM pp), b AS (SELECT query_id, CASE WHEN count(DISTINCT side) < 2 THEN '1' ELSE '0' END AS one FROM sd GROUP BY ALL)
      SELECT query_id, doc_id, side, row_number() OVER (PARTITION BY query_id, side ORDER BY retrieval_rank, doc_id) AS round, one || md5('42:' || query_id) AS query_place FROM sd JOIN b USING (query_id)""",
    "s_p16_groups": f"""{_PAIRS}, ng AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY k) AS negatives FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_rank, doc_id) AS k FROM pp WHERE label <= 0.5) WHERE k <= 7 GROUP BY query_id)
      SELECT DISTINCT query_id, doc_id AS positive, negatives FROM pp JOIN ng USING (query_id) WHERE label > 0.5""",
    "s_p19_subset": f"""{P.with_tables('qs', 'rels', 'docs')}, q AS (SELECT query_id FROM qs ORDER BY md5(query_id) LIMIT 50), need AS (SELECT DISTINCT doc_id FROM rels WHERE query_id IN (SELECT query_id FROM q) AND doc_id IN (SELECT doc_id FROM docs))
      SELECT doc_id, true AS positive FROM need UNION ALL SELECT doc_id, false FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id)) AS k FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM need)) WHERE k <= greatest(0, 120 - (SELECT count(*) FROM need))""",
    "s_p20_splits": "SELECT unnest(['fewer than two folds', 'query in several folds', 'query without fold', 'fold query unknown', 'fold query without relevant document', 'query on both sides', 'relevant document on both sides']) AS check_name, 0::BIGINT AS n",
    "v11_missing": "SELECT * FROM (VALUES ('missing column chunks.granularity', 1), ('missing column chunks.parent_chunk_id', 1), ('missing column chunks.token_count', 1), ('missing column chunks.is_empty', 1), ('missing column queries.gold_count', 1)) AS t(check_name, n)",
}
SQL["v11_renamed"] = SQL["v10_violations"]
