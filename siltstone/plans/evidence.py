"""Queries on evidence, reranking, selection, features and learned fusion.

Candidates are the fused stored branches of every query, and evidence is built
for all of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import evidence as E
from siltstone.operators import learning as G
from siltstone.operators import memory as Y
from siltstone.operators import ranking as R
from siltstone.operators import rerank as K
from siltstone.operators.splits import bucket_folds
from siltstone.plans import pipeline as O
from siltstone.plans import sqlparts as P
from siltstone.plans.retrieval import _FUSED, ranked_sql, ranks_sql
from siltstone.sources import canonical as C
from siltstone.sources.tables import table
from siltstone.storage import cut, settled

DEPTH, TOP = 200, 10


def _fused(s, d, top_k=TOP):
    return R.fuse(R.branch_ranks(table(s, d, "static_candidates"), DEPTH), top_k=top_k)


def _prior(s, d):
    """The best chunk of a candidate in the dense branch, else in the lexical one."""
    t = table(s, d, "static_candidates").filter("best_chunk_id is not null and branch in ('dense', 'bm25')")
    return t.groupBy("query_id", "doc_id").agg(F.coalesce(F.max(F.when(F.col("branch") == "dense", F.col("best_chunk_id"))), F.max("best_chunk_id")).alias("prior_chunk_id"))


def _candidates(s, d):
    return _fused(s, d).join(_prior(s, d), ["query_id", "doc_id"], "left")


def _questions(s, d):
    return C.questions(s, d).select("query_id", F.col("question_raw").alias("question"))


def _macros(s, d):
    return C.chunks(s, d).filter("granularity = 'macro' and doc_id is not null")


def _scored(s, d):
    return E.scored_chunks(_candidates(s, d), _questions(s, d), _macros(s, d))


def e01_chunk_info(s, d):
    i = E.chunk_info(_macros(s, d))
    return i.select("chunk_id", F.size("tokens").alias("n_tokens"), *[F.array_join(F.sort_array(k), ",").alias(k) for k in E.LABEL])


def e02_query_info(s, d):
    q = E.query_info(_questions(s, d))
    return q.select("query_id", F.size("q_tokens").alias("n_tokens"), F.size("q_phrases").alias("n_phrases"), F.array_join("q_phrases", "|").alias("phrases"))


def e03_chunk_scores(s, d):
    return _scored(s, d).select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"))


def e04_selected(s, d):
    got = E.selected(_scored(s, d), 3)
    return got.select("query_id", "doc_id", F.array_join(F.transform("chunks", lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


def _packs(s, d, **kw):
    return E.packs(E.selected(_scored(s, d), 2), C.docs(s, d), **kw)


def e05_packs(s, d):
    return _packs(s, d).select("query_id", "doc_id", "pack")


def e05_token_packs(s, d):
    return _packs(s, d, max_tokens=120, article_prefix=True).select("query_id", "doc_id", "pack")


def e06_records(s, d):
    return E.records(_packs(s, d), C.docs(s, d)).select("query_id", "doc_id", "n", "chunk_id", "reranker_text", F.md5("text").alias("digest"))


def e07_lines(s, d):
    return E.lines(E.selected(_scored(s, d), 2), C.docs(s, d))


def e08_positives(s, d):
    """The chunk that answers a training question in each of its relevant documents."""
    got = E.selected(E.scored_chunks(C.relevant(s, d), _questions(s, d), _macros(s, d), training=True), 1, skip_empty=False)
    return got.select("query_id", "doc_id", F.get("chunks", F.lit(0))["chunk_id"].alias("chunk_id"))


def _pair_scores(s, d):
    rec = E.records(_packs(s, d), C.docs(s, d)).join(_questions(s, d), "query_id")
    return rec.select("query_id", "doc_id", "chunk_id", K.shared_words(F.col("question"), F.when(F.col("n") == 1, F.col("pack")).otherwise(F.col("reranker_text"))).alias("pair_score"))


def _full_texts(s, d):
    return _fused(s, d).select("query_id", "doc_id").join(_questions(s, d), "query_id").join(C.docs(s, d).select("doc_id", "document_text"), "doc_id")


def k02_shared_words(s, d):
    return _full_texts(s, d).select("query_id", "doc_id", K.shared_words(F.col("question"), F.col("document_text")).alias("score"))


def k01_pair_scores(s, d):
    """The same scores through the hook for a scorer over batches of texts."""
    rec = E.records(_packs(s, d), C.docs(s, d)).join(_questions(s, d), "query_id").select("query_id", "doc_id", "chunk_id", "question", F.col("reranker_text").alias("passage"))
    return K.scored_by(rec, overlap).select("query_id", "doc_id", "chunk_id", "pair_score")


def overlap(questions: list[str], passages: list[str]) -> list[float]:
    return [float(len(set(q.lower().split()) & set(p.lower().split()))) for q, p in zip(questions, passages, strict=True)]


def k03_by_document(s, d):
    return K.by_document(_pair_scores(s, d))


def k04_reranked(s, d):
    got = K.reranked(_candidates(s, d).select("query_id", "doc_id", "rank", "rrf_score"), K.by_document(_pair_scores(s, d)), 5)
    return got.select("query_id", "doc_id", "rank", "reranker_score", "reranker_second_score", "reranker_margin", "evidence_chunk_count", "rerank_rank")


def k05_texts(s, d):
    return K.rerank_texts(_full_texts(s, d), "question", "document_text", 5).select("query_id", "doc_id", "reranker_score", "final_rank")


def k06_ensemble(s, d):
    """Two scorers: shared words of question and pack or chunk with its label, and of question and bare chunk."""
    one = _pair_scores(s, d)
    rec = E.records(_packs(s, d), C.docs(s, d)).join(_questions(s, d), "query_id")
    two = rec.select("query_id", "doc_id", "chunk_id", K.shared_words(F.col("question"), F.col("chunk_text")).alias("pair_score"))
    both = one.withColumn("member", F.lit(0)).union(two.withColumn("member", F.lit(1)))
    return K.ensemble(both, ["query_id", "doc_id", "chunk_id"], 2)


def _with_exact(s, d, top_k=TOP):
    return _fused(s, d, top_k).withColumn("exact_score", F.coalesce("exact_score", F.lit(0.0))).withColumn("reranker_score", F.lit(K.UNSCORED))


def l01_final(s, d):
    got = R.final_rrf(_with_exact(s, d))
    return got.select("query_id", "doc_id", F.round("final_score", 8).alias("final_score"), "final_rank")


def l10_static_fusion(s, d):
    """Stored branches pivoted by document as delivered: least rank a branch, greatest exact score, fixed fusion."""
    t = table(s, d, "static_candidates")
    x = F.col("score").cast("double")
    ok = t.filter("query_id is not null and doc_id is not null and rank is not null").filter(~F.isnan(x) & (F.abs(x) != float("inf"))).select("query_id", "branch", "doc_id", "rank", x.alias("score")).distinct()
    w = R.weight_of("branch", R.BRANCH_WEIGHTS)
    part = F.when(F.col("branch") == "exact", w * 0.05 * F.col("score")).otherwise(w / (60 + F.col("rank")))
    rank = lambda b: F.coalesce(F.min(F.when(F.col("branch") == b, F.col("rank"))), F.lit(999)).alias(f"{b}_rank")
    g = ok.groupBy("query_id", "doc_id").agg(rank("bm25"), rank("bm25_pyvi"), rank("dense"), F.coalesce(F.max(F.when(F.col("branch") == "exact", F.col("score"))), F.lit(0.0)).alias("exact_score"), F.count_distinct("branch").alias("source_count"), F.sum(part).alias("rrf_score"))
    got = R.final_rrf(g.withColumn("memory_rank", F.lit(999)).withColumn("reranker_score", F.lit(K.UNSCORED))).filter("final_rank <= 5")
    return got.select("query_id", "doc_id", "bm25_rank", "bm25_pyvi_rank", "dense_rank", F.round("exact_score", 6).alias("exact_score"), "source_count", F.round("final_score", 8).alias("final_score"), "final_rank")


def l08_answers(s, d):
    got = K.answers(_fused(s, d), 5, fill=5, valid=C.docs(s, d).select("doc_id"))
    return got.select("query_id", F.array_join("answer", ",").alias("answer"))


def l06_prior(s, d):
    return G.document_prior(C.relevant(s, d)).select("doc_id", F.round("train_doc_freq", 8).alias("train_doc_freq"))


def _features(s, d):
    c = _with_exact(s, d, 30).drop("reranker_score").join(C.questions(s, d).select("query_id", F.length(F.trim("question_raw")).cast("double").alias("query_length")), "query_id", "left")
    c = c.join(bucket_folds(C.questions(s, d).select("query_id")), "query_id")
    return G.features(c, G.document_prior(C.relevant(s, d)), C.relevant(s, d))


def _held_out(s, d):
    """Features of candidates with question memory and document prior of the other folds; each table is read and cleaned once."""
    q, rel = settled(_questions(s, d), "questions"), settled(C.relevant(s, d), "relevant")
    folds = settled(bucket_folds(q.select("query_id")), "folds")
    memory = settled(O.fold_memory(q, q, rel, folds, O.Settings(memory_threshold=Y.THRESHOLD)).drop("best_chunk_id"), "memory")
    ranks = R.branch_ranks(table(s, d, "static_candidates"), DEPTH).select("query_id", "branch", "doc_id", "rank", "score")
    fused = settled(R.fuse(ranks.unionByName(memory), top_k=30), "fused")
    return O.fold_features(fused, q, rel, folds)


def _shown_features(f):
    cols = ["raw_bm25_rank", "pyvi_bm25_rank", "dense_rank", "memory_rank", "exact_score", "source_count", "rrf_score", "reranker_score", "query_length", "train_doc_freq", "bm25_inv_rank", "dense_inv_rank"]
    return f.select("query_id", "doc_id", "fold", "label", *[F.round(c, 7).alias(c) for c in cols])


def l04_features(s, d):
    """Features as the SQL states them, with one prior of all judgements; what is tested out of fold reads ``l12_features``."""
    return _shown_features(_features(s, d))


def l12_features(s, d):
    return _shown_features(_held_out(s, d))


LEARNED = ["raw_bm25_rank", "pyvi_bm25_rank", "dense_rank", "exact_score", "source_count", "rrf_score", "train_doc_freq"]
HELD_OUT = [*LEARNED, "memory_rank", "memory_score"]


def l02_ridge(s, d):
    m = G.Ridge(LEARNED).fit(_features(s, d))
    return s.createDataFrame([(c, round(float(w), 6)) for c, w in zip([*LEARNED, "intercept"], [*m.coefficients, m.intercept], strict=True)], "feature string, weight double")


def l07_cross_fitted(s, d):
    got = G.cross_fitted(settled(_held_out(s, d), "features"), HELD_OUT).filter("final_rank <= 5")
    return got.select("query_id", "doc_id", "fold", F.round("final_score", 6).alias("final_score"), "final_rank")


def l07_gate(s, d):
    """Pooled measures of learned and fixed fusion on held-out features, and which of them the gate takes."""
    f = settled(_held_out(s, d), "features")
    chosen, _, pooled = G.gated(f, HELD_OUT, C.relevant(s, d))
    return s.createDataFrame([(k, round(m["recall"], 6), round(m["precision"], 6), k == chosen) for k, m in sorted(pooled.items())], "ranking string, recall double, precision double, chosen boolean")


def l07_predeclared(s, d):
    """The gate with fixed fusion declared beforehand, on features of all folds."""
    chosen, _, pooled = G.gated(cut(_features(s, d), "features"), LEARNED, C.relevant(s, d), predeclared=True)
    return s.createDataFrame([(chosen, round(pooled["fixed"]["recall"], 6), round(pooled["fixed"]["precision"], 6))], "ranking string, recall double, precision double")


def l03_boosted(s, d):
    """Pointwise boosted trees; each fold is ranked by a model of the others."""
    got = G.cross_boosted(settled(_held_out(s, d), "features"), HELD_OUT, rounds=5, depth=3).filter("final_rank <= 5")
    return got.select("query_id", "doc_id", F.round("final_score", 6).alias("final_score"), "final_rank")


def l05_matrix(s, d):
    return G.union_matrix(_fused(s, d), C.relevant(s, d)).select("query_id", "doc_id", "source_count", "bm25_rank", "dense_rank", "exact_rank", "label")


def l11_by_fixed(s, d):
    """Feature rows ranked by fixed fusion, answered and measured."""
    from siltstone.operators import metrics

    ranked = G.rank_by_fixed(_features(s, d)).select("query_id", "doc_id", F.col("final_rank").alias("rank"))
    a = K.answers(ranked, 5)
    m = metrics.means(metrics.per_query(a, C.relevant(s, d).join(a.select("query_id"), "query_id", "left_semi")))
    return m.select(*[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")], "n_queries")


def k08_table(s, d):
    t = _fused(s, d).select(F.col("query_id").alias("qid"), F.col("doc_id").alias("document_id")).join(_questions(s, d).withColumnRenamed("query_id", "qid"), "qid")
    t = t.join(C.docs(s, d).select(F.col("doc_id").alias("document_id"), F.col("document_text").alias("text")), "document_id")
    state, m = K.evaluated_table(t, C.relevant(s, d))
    return m.select(F.lit(state).alias("state"), *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "n_queries")


def p18_losses(s, d):
    """Training losses on stored dense scores, as evaluation: relevant against the mean of the others of a query."""
    f = _features(s, d)
    pos = f.filter("label = 1").select("query_id", "doc_id", (F.col("rrf_score") * 10).alias("pos"))
    neg = f.filter("label = 0").groupBy("query_id").agg(F.avg(F.col("rrf_score") * 10).alias("neg"), F.count(F.lit(1)).alias("n"))
    x = G.losses()
    r = pos.join(neg, "query_id").select("query_id", "doc_id", "pos", "neg", F.col("pos").alias("logit"), F.lit(1.0).alias("label"), F.array("pos", "neg").alias("scores"))
    return r.select("query_id", "doc_id", *[F.round(c, 6).alias(k) for k, c in x.items()])


QUERIES = {
    "e01_chunk_info": e01_chunk_info, "e02_query_info": e02_query_info, "e03_chunk_scores": e03_chunk_scores, "e04_selected": e04_selected, "e05_packs": e05_packs, "e05_token_packs": e05_token_packs,
    "e06_records": e06_records, "e07_lines": e07_lines, "e08_positives": e08_positives, "k01_pair_scores": k01_pair_scores, "k02_shared_words": k02_shared_words, "k03_by_document": k03_by_document,
    "k04_reranked": k04_reranked, "k05_texts": k05_texts, "k06_ensemble": k06_ensemble, "l01_final": l01_final, "l02_ridge": l02_ridge, "l03_boosted": l03_boosted, "l05_matrix": l05_matrix, "l11_by_fixed": l11_by_fixed, "k08_table": k08_table, "l04_features": l04_features, "l12_features": l12_features, "l06_prior": l06_prior, "l07_cross_fitted": l07_cross_fitted, "l07_gate": l07_gate, "l07_predeclared": l07_predeclared,
    "l08_answers": l08_answers, "l10_static_fusion": l10_static_fusion, "q18_losses": p18_losses,
}

_CLEANQ = P.clean("question_raw")
_PHRASES = "CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END"
_CAND = f"""{ranks_sql(DEPTH)}, {', '.join(f'{n} AS MATERIALIZED ({P.LAST[n]})' for n in ('docs', 'cks', 'qs', 'rels'))}, {_FUSED},
  top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM fused) WHERE rank <= {TOP})"""


def _has(signal: str, test: str) -> str:
    return f"len(list_filter({signal}, lambda v: {test})) > 0"


def _overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) > 0"


def _loose(word: str, value: str, label: str) -> str:
    return f"list_concat({P.found(f'lower({label})', rf'{P.B0}{word}{X.WS}+({value})', 1)}, {P.found('lower(left(body, 600))', rf'{P.B0}{word}{X.WS}+({value})', 1)})"


def _shown(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND lower(trim({c})) NOT IN ('', 'nan', 'nat', 'none', 'null') THEN trim({c}) ELSE '' END"


_INFO = f"""body AS (SELECT {P.given('document_id')} AS doc_id, chunk_id, {_shown('article')} AS article, {_shown('clause')} AS clause, {_shown('point')} AS point, {_shown("CASE WHEN text_raw <> '' THEN text_raw ELSE text_norm END")} AS body FROM cks WHERE granularity = 'macro'),
  info AS MATERIALIZED (SELECT *, {P.word_tokens('body')} AS tokens, {_loose('điều', '[\\p{Nd}]+[a-zA-Z]?', 'article')} AS articles, {_loose('khoản', '[\\p{Nd}]+[a-zA-Z]?', 'clause')} AS clauses, {_loose('điểm', '[a-zA-Z\\p{Nd}]+', 'point')} AS points FROM body WHERE doc_id IS NOT NULL)"""
_QI = f"""qi AS MATERIALIZED (SELECT query_id, {P.word_tokens(_CLEANQ)} AS w, list_transform({P.articles(_CLEANQ)}, lambda e: lower(e)) AS qa, list_transform({P.clauses(_CLEANQ)}, lambda e: lower(e)) AS qc, list_transform({P.points(_CLEANQ)}, lambda e: lower(e)) AS qp,
  list_transform({P.doc_numbers(_CLEANQ)}, lambda e: lower(e)) AS qn, {P.years(_CLEANQ)} AS qy FROM qs)"""
def _e3(pairs: str, training: bool = False) -> str:
    """Chunk scores of ``pairs``, a query of ``query_id, doc_id, prior`` and the chunk's columns."""
    late = "" if training else f"""+ CASE WHEN {_has('qy', 'contains(b, v)')} THEN 1.5 ELSE 0 END
    + 2.5 * len(list_filter({_PHRASES}, lambda v: contains(b, v))) + CASE WHEN prior = p.chunk_id THEN 5.0 ELSE 0 END"""
    return f"""{_CAND}, {_INFO}, {_QI},
  prior AS (SELECT query_id, doc_id, coalesce(max(best_chunk_id) FILTER (branch = 'dense'), max(best_chunk_id)) AS prior FROM static_candidates WHERE best_chunk_id IS NOT NULL AND branch IN ('dense', 'bm25') GROUP BY ALL),
  pairs AS MATERIALIZED ({pairs}),
  ct AS (SELECT chunk_id, term, sum(n) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term, 1 AS n FROM info UNION ALL SELECT chunk_id, unnest({P.word_tokens('article')}), 2 FROM info) GROUP BY ALL),
  qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(w) AS term FROM qi) GROUP BY ALL),
  ov AS (SELECT p.query_id, p.chunk_id, sum(qf * (1 + ln(1 + tf))) AS overlap FROM (SELECT DISTINCT query_id, chunk_id FROM pairs) p JOIN qt USING (query_id) JOIN ct ON ct.chunk_id = p.chunk_id AND ct.term = qt.term GROUP BY ALL),
  e3 AS MATERIALIZED (SELECT p.query_id, p.doc_id, p.chunk_id,
    CASE WHEN {_overlap('qa', 'articles')} THEN 20.0 WHEN {_has('qa', "contains(a, 'điều ' || v) OR a = v")} THEN 18.0 WHEN {_has('qa', "contains(b, 'điều ' || v)")} THEN 12.0 ELSE 0 END
    + CASE WHEN {_overlap('qc', 'clauses')} THEN 8.0 WHEN {_has('qc', "contains(b, 'khoản ' || v) OR contains(b, v || '.')")} THEN 5.0 ELSE 0 END
    + CASE WHEN {_overlap('qp', 'points')} THEN 4.0 WHEN {_has('qp', "contains(b, 'điểm ' || v) OR contains(b, v || ')')")} THEN 3.0 ELSE 0 END
    + CASE WHEN {_has('qn', 'contains(b, v)')} THEN 6.0 ELSE 0 END {late}
    + CASE WHEN len(tokens) > 0 THEN 2.0 * coalesce(overlap, 0) / (sqrt(len(tokens)) + 1) ELSE 0 END AS score
    FROM pairs p JOIN qi USING (query_id) LEFT JOIN ov ON ov.query_id = p.query_id AND ov.chunk_id = p.chunk_id)"""


_E3 = _e3("SELECT t.query_id, t.doc_id, prior, i.* EXCLUDE (doc_id), lower(body) AS b, lower(article) AS a FROM top t LEFT JOIN prior p ON p.query_id = t.query_id AND p.doc_id = t.doc_id JOIN info i ON i.doc_id = t.doc_id")
_E8 = _e3("SELECT t.query_id, t.doc_id, NULL AS prior, i.* EXCLUDE (doc_id), lower(body) AS b, lower(article) AS a FROM rels t JOIN info i ON i.doc_id = t.doc_id", training=True)


def _chosen(k: int) -> str:
    """``sel``: the chosen chunks of a pair in order, by walking its chunks from the best one."""
    like = "len(list_filter(s.ws, lambda t: len(t) > 0 AND len(list_intersect(t, o.w))::DOUBLE / greatest(len(t) + len(o.w) - len(list_intersect(t, o.w)), 1) >= 0.85)) > 0"
    take = f"len(s.ids) < {k} AND NOT (len(o.w) = 0 OR {like})"
    return f"""{_E3.replace('WITH', 'WITH RECURSIVE', 1)},
  ordered AS MATERIALIZED (SELECT e.query_id, e.doc_id, e.chunk_id, row_number() OVER (PARTITION BY e.query_id, e.doc_id ORDER BY round(score, 9) DESC, e.chunk_id) AS i, list_distinct(tokens) AS w FROM e3 e JOIN (SELECT DISTINCT chunk_id, tokens FROM info) USING (chunk_id)),
  walk AS (SELECT DISTINCT query_id, doc_id, 0::BIGINT AS i, []::VARCHAR[] AS ids, []::VARCHAR[][] AS ws FROM ordered
    UNION ALL SELECT s.query_id, s.doc_id, o.i, CASE WHEN {take} THEN list_append(s.ids, o.chunk_id) ELSE s.ids END, CASE WHEN {take} THEN list_append(s.ws, o.w) ELSE s.ws END FROM walk s JOIN ordered o ON o.query_id = s.query_id AND o.doc_id = s.doc_id AND o.i = s.i + 1),
  whole AS (SELECT query_id, doc_id, list(chunk_id ORDER BY i) AS every FROM ordered GROUP BY ALL),
  sel AS MATERIALIZED (SELECT w.query_id, w.doc_id, (CASE WHEN len(every) = 1 THEN every ELSE list_concat(ids, list_filter(every, lambda x: NOT list_contains(ids, x))) END)[1:{k}] AS ids FROM walk w JOIN whole h ON h.query_id = w.query_id AND h.doc_id = w.doc_id AND w.i = len(every))"""


def _cut(x: str, limit: str) -> str:
    head = f"substr({x}, 1, ({limit}) - 3)"
    space = f"(({limit}) - 3 - instr(reverse({head}), ' '))"
    return f"CASE WHEN length({x}) <= ({limit}) THEN {x} ELSE regexp_replace(CASE WHEN instr({head}, ' ') > 0 AND {space} > floor((({limit}) - 3) / 2) THEN substr({x}, 1, {space}) ELSE {head} END, '{X.WS}+$', '') || '...' END"


def _or(c: str, other: str) -> str:
    return f"CASE WHEN {_shown(c)} <> '' THEN {_shown(c)} ELSE {other} END"


_LABELS = f"""lab AS (SELECT doc_id, CASE WHEN {_shown('legal_number')} <> '' THEN trim(concat_ws(' ', t, {_shown('legal_number')})) ELSE t END AS label, t FROM (SELECT *, {_or('title', _or('name_raw', "'Văn bản ' || doc_id"))} AS t FROM docs)),
  part AS MATERIALIZED (SELECT s.query_id, s.doc_id, i, len(ids) AS n, ids[i] AS chunk_id, trim(b.body) AS body, b.article, label, '[DOCUMENT] ' || coalesce(label, 'Văn bản ' || s.doc_id) AS head FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM sel) s JOIN (SELECT chunk_id, any_value(body) AS body, any_value(article) AS article FROM info GROUP BY chunk_id) b ON b.chunk_id = ids[i] LEFT JOIN lab ON lab.doc_id = s.doc_id)"""
_SHARE = "CASE WHEN n = 1 THEN room WHEN i = 1 THEN greatest(150, floor(room * 0.6)) ELSE greatest(100, floor(room * (0.4 / greatest(n - 1, 1)))) END::INT"
_PACKS = f"""{_chosen(2)}, {_LABELS}, roomy AS (SELECT *, greatest(100, 1200 - length(head) - n * 15) AS room FROM part), share AS (SELECT *, {_SHARE} AS lim FROM roomy),
  pk AS MATERIALIZED (SELECT query_id, doc_id, any_value(head) || ' ' || string_agg('[EVIDENCE ' || i || '] ' || {_cut('body', 'lim')}, ' ' ORDER BY i) AS pack FROM share GROUP BY ALL),
  rec AS MATERIALIZED (SELECT p.query_id, p.doc_id, i AS n, p.n AS of, p.chunk_id, pack, trim(left(p.body, 1200), ' ') AS chunk_text, '[DOCUMENT] ' || label || ' [EVIDENCE 1] ' || trim(left(p.body, 1200), ' ') AS reranker_text, question_raw AS question, article, p.body FROM part p JOIN pk USING (query_id, doc_id) LEFT JOIN qs ON qs.query_id = p.query_id)"""
_WORDSET = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{X.WS}+'), lambda w: w <> ''))"
_K2 = f"""{_CAND}, k2 AS (SELECT t.query_id, t.doc_id, question_raw AS question, document_text AS body FROM top t JOIN qs ON qs.query_id = t.query_id JOIN docs ON docs.doc_id = t.doc_id)"""
def _words(a: str, b: str) -> str:
    return f"len(list_intersect({_WORDSET(a)}, {_WORDSET(b)}))::DOUBLE"


_SCORED = f"""{_PACKS}, sc AS MATERIALIZED (SELECT query_id, doc_id, chunk_id, {_words('question', 'CASE WHEN n = 1 THEN pack ELSE reranker_text END')} AS pair_score, {_words('question', 'chunk_text')} AS other FROM rec),
  bd AS (SELECT query_id, doc_id, max(pair_score) AS reranker_score, coalesce(list(pair_score ORDER BY pair_score DESC)[2], max(pair_score)) AS reranker_second_score, first(chunk_id ORDER BY pair_score DESC, chunk_id) AS reranker_best_chunk_id, count(*) AS evidence_chunk_count FROM sc GROUP BY ALL)"""
_FINAL = """CASE WHEN coalesce(bm25_rank, 999) < 900 THEN 1.0 / (60 + bm25_rank) ELSE 0 END + CASE WHEN coalesce(bm25_pyvi_rank, 999) < 900 THEN 1.0 / (60 + bm25_pyvi_rank) ELSE 0 END
  + CASE WHEN coalesce(dense_rank, 999) < 900 THEN 1.2 / (60 + dense_rank) ELSE 0 END + CASE WHEN exact_score > 0 THEN 2.5 * 0.05 * exact_score ELSE 0 END"""
_EX = "ex AS (SELECT query_id, doc_id, max(score) AS exact_score FROM ranks WHERE branch = 'exact' GROUP BY ALL)"
_FOLD = "CAST(('0x' || left(md5(query_id), 8)) AS BIGINT) % 5"
_FEAT = f"""{_CAND}, {_EX}, prior AS (SELECT doc_id, count(*) / (SELECT count(DISTINCT query_id) FROM rels) AS f FROM rels GROUP BY doc_id),
  t30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM fused) WHERE rank <= 30),
  feat AS (SELECT t.query_id, t.doc_id, {_FOLD.replace('query_id', 't.query_id')} AS fold, CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END AS label, coalesce(bm25_rank, 999)::DOUBLE AS raw_bm25_rank, coalesce(bm25_pyvi_rank, 999)::DOUBLE AS pyvi_bm25_rank, coalesce(dense_rank, 999)::DOUBLE AS dense_rank,
    999.0::DOUBLE AS memory_rank, coalesce(exact_score, 0)::DOUBLE AS exact_score, source_count::DOUBLE AS source_count, rrf_score, -999.0::DOUBLE AS reranker_score, length(trim(question_raw))::DOUBLE AS query_length, coalesce(f, 0) AS train_doc_freq,
    CASE WHEN bm25_rank < 900 THEN 1.0 / (60 + bm25_rank) ELSE 0 END AS bm25_inv_rank, CASE WHEN dense_rank < 900 THEN 1.0 / (60 + dense_rank) ELSE 0 END AS dense_inv_rank
    FROM t30 t JOIN qs ON qs.query_id = t.query_id LEFT JOIN ex ON ex.query_id = t.query_id AND ex.doc_id = t.doc_id LEFT JOIN prior ON prior.doc_id = t.doc_id LEFT JOIN rels r ON r.query_id = t.query_id AND r.doc_id = t.doc_id)"""
SQL = {
    "e01_chunk_info": f"{P.with_tables('cks')}, {_INFO} SELECT chunk_id, len(tokens) AS n_tokens, " + ", ".join(f"array_to_string(list_sort(list_distinct({k})), ',') AS {k}" for k in E.LABEL) + " FROM info",
    "e02_query_info": f"{P.with_tables('qs')}, {_QI} SELECT query_id, len(w) AS n_tokens, len({_PHRASES}) AS n_phrases, array_to_string({_PHRASES}, '|') AS phrases FROM qi",
    "e03_chunk_scores": f"{_E3} SELECT query_id, doc_id, chunk_id, round(score, 6) AS score FROM e3",
    "k02_shared_words": f"{_K2} SELECT query_id, doc_id, len(list_intersect({_WORDSET('question')}, {_WORDSET('body')}))::DOUBLE AS score FROM k2",
    "k05_texts": f"""{_K2}, sc AS (SELECT query_id, doc_id, len(list_intersect({_WORDSET('question')}, {_WORDSET('left(body, 1000)')}))::DOUBLE AS reranker_score FROM k2)
      SELECT query_id, doc_id, reranker_score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, doc_id) AS final_rank FROM sc) WHERE final_rank <= 5""",
    "l01_final": f"""{_CAND}, {_EX}, f AS (SELECT t.query_id, t.doc_id, {_FINAL} AS s, rrf_score FROM top t LEFT JOIN ex ON ex.query_id = t.query_id AND ex.doc_id = t.doc_id), g AS (SELECT query_id, doc_id, CASE WHEN s = 0 THEN rrf_score ELSE s END AS final_score FROM f)
      SELECT query_id, doc_id, round(final_score, 8) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, doc_id) AS final_rank FROM g""",
    "l10_static_fusion": f"""WITH ok AS (SELECT DISTINCT query_id, branch, doc_id, rank, score::DOUBLE AS score FROM static_candidates WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND rank IS NOT NULL AND isfinite(score)),
      g AS (SELECT query_id, doc_id, coalesce(min(rank) FILTER (branch = 'bm25'), 999) AS bm25_rank, coalesce(min(rank) FILTER (branch = 'bm25_pyvi'), 999) AS bm25_pyvi_rank, coalesce(min(rank) FILTER (branch = 'dense'), 999) AS dense_rank, coalesce(max(score) FILTER (branch = 'exact'), 0) AS exact_score,
        count(DISTINCT branch) AS source_count, sum(CASE branch WHEN 'exact' THEN 2.5 * 0.05 * score WHEN 'dense' THEN 1.2 / (60 + rank) ELSE 1.0 / (60 + rank) END) AS rrf_score FROM ok GROUP BY ALL),
      h AS (SELECT *, {_FINAL} AS s FROM g), k AS (SELECT *, CASE WHEN s = 0 THEN rrf_score ELSE s END AS final_score FROM h)
      SELECT query_id, doc_id, bm25_rank, bm25_pyvi_rank, dense_rank, round(exact_score, 6) AS exact_score, source_count, round(final_score, 8) AS final_score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, doc_id) AS final_rank FROM k) WHERE final_rank <= 5""",
    "l08_answers": f"""{_CAND}, v AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM top WHERE doc_id IN (SELECT doc_id FROM docs)),
      fill AS (SELECT list(doc_id ORDER BY doc_id) AS f FROM (SELECT doc_id FROM docs ORDER BY doc_id LIMIT 10)),
      l AS (SELECT query_id, list(doc_id ORDER BY place) AS a FROM v WHERE place <= 5 GROUP BY query_id), q AS (SELECT DISTINCT query_id FROM top)
      SELECT query_id, array_to_string({P.distinct("list_concat(coalesce(a, []), f)")}[1:5], ',') AS answer FROM q LEFT JOIN l USING (query_id), fill""",
    "l05_matrix": f"{_CAND} SELECT t.query_id AS query_id, t.doc_id AS doc_id, source_count, coalesce(bm25_rank, 999) AS bm25_rank, coalesce(dense_rank, 999) AS dense_rank, coalesce(exact_rank, 999) AS exact_rank, CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END AS label FROM top t LEFT JOIN rels r ON r.query_id = t.query_id AND r.doc_id = t.doc_id",
    "l06_prior": f"{P.with_tables('rels')} SELECT doc_id, round(count(*) / (SELECT count(DISTINCT query_id) FROM rels), 8) AS train_doc_freq FROM rels GROUP BY doc_id",
    "l04_features": f"{_FEAT} SELECT query_id, doc_id, fold, label, " + ", ".join(f"round({c}, 7) AS {c}" for c in ["raw_bm25_rank", "pyvi_bm25_rank", "dense_rank", "memory_rank", "exact_score", "source_count", "rrf_score", "reranker_score", "query_length", "train_doc_freq", "bm25_inv_rank", "dense_inv_rank"]) + " FROM feat",
    "q18_losses": f"""{_FEAT}, pos AS (SELECT query_id, doc_id, rrf_score * 10 AS pos FROM feat WHERE label = 1), neg AS (SELECT query_id, avg(rrf_score * 10) AS neg FROM feat WHERE label = 0 GROUP BY ALL)
      SELECT query_id, doc_id, round(ln(1 + exp(-pos)), 6) AS bce, round(ln(1 + exp(neg - pos)), 6) AS pairwise_logistic, round(greatest(0, 1 - (pos - neg)), 6) AS pairwise_margin, round(ln(1 + exp(neg - pos)), 6) AS listwise FROM pos JOIN neg USING (query_id)""",
    "e04_selected": f"{_chosen(3)} SELECT query_id, doc_id, array_to_string(ids, ',') AS chunk_ids FROM sel",
    "e05_packs": f"{_PACKS} SELECT query_id, doc_id, pack FROM pk",
    "e06_records": f"""{_PACKS}, d AS (SELECT doc_id, t, {_shown('legal_number')} AS number FROM docs JOIN lab USING (doc_id)),
      x AS (SELECT r.*, pack || CASE WHEN n = 1 THEN ' [VĂN BẢN]: ' || t || CASE WHEN number <> '' THEN ' (Số: ' || number || ')' ELSE '' END || chr(10) || '[ĐIỀU KHOẢN]: ' || CASE WHEN r.article <> '' THEN r.article ELSE 'Thông tin văn bản' END || chr(10) || '[NỘI DUNG]:' || chr(10) || full_body ELSE '' END AS full_text
        FROM rec r LEFT JOIN d USING (doc_id) JOIN (SELECT chunk_id, any_value(body) AS full_body FROM info GROUP BY chunk_id) USING (chunk_id))
      SELECT query_id, doc_id, n, chunk_id, reranker_text, md5(full_text) AS digest FROM x""",
    "e07_lines": f"""{_chosen(2)}, {_LABELS}, h AS (SELECT doc_id, trim(concat_ws(' ', nullif({_or('title', P.pretty_title('name_raw'))}, ''), nullif({_shown('legal_number')}, ''))) AS h FROM docs),
      b AS (SELECT p.*, {_cut('full_body', '1200')} AS short, CASE WHEN coalesce(h, '') = '' THEN 'Văn bản quy phạm pháp luật' ELSE h END AS h FROM part p JOIN (SELECT chunk_id, any_value(body) AS full_body FROM info GROUP BY chunk_id) USING (chunk_id) LEFT JOIN h USING (doc_id))
      SELECT query_id, doc_id, '[DOCUMENT] ' || any_value(h) || chr(10) || string_agg('[EVIDENCE ' || i || '] ' || CASE WHEN article <> '' AND NOT starts_with(short, article) THEN article || ': ' || short ELSE short END, chr(10) ORDER BY i) AS text FROM b GROUP BY ALL""",
    "e08_positives": f"{_E8} SELECT query_id, doc_id, first(chunk_id ORDER BY round(score, 9) DESC, chunk_id) AS chunk_id FROM e3 GROUP BY ALL",
    "k01_pair_scores": f"{_PACKS} SELECT query_id, doc_id, chunk_id, {_words('question', 'reranker_text')} AS pair_score FROM rec",
    "k03_by_document": f"{_SCORED} SELECT query_id, doc_id, reranker_score, reranker_second_score, reranker_score - reranker_second_score AS reranker_margin, reranker_best_chunk_id, evidence_chunk_count FROM bd",
    "k04_reranked": f"""{_SCORED}, j AS (SELECT t.query_id, t.doc_id, rank, rank <= 5 AS head, b.* EXCLUDE (query_id, doc_id) FROM top t LEFT JOIN bd b ON b.query_id = t.query_id AND b.doc_id = t.doc_id)
      SELECT query_id, doc_id, rank, CASE WHEN head THEN coalesce(reranker_score, 0) ELSE -999.0 END AS reranker_score, CASE WHEN head THEN coalesce(reranker_second_score, 0) ELSE -999.0 END AS reranker_second_score,
        CASE WHEN head THEN coalesce(reranker_score - reranker_second_score, 0) ELSE 0.0 END AS reranker_margin, CASE WHEN head THEN coalesce(evidence_chunk_count, 0) ELSE 0 END AS evidence_chunk_count,
        row_number() OVER (PARTITION BY query_id ORDER BY head DESC, CASE WHEN head THEN -coalesce(reranker_score, 0) END, CASE WHEN NOT head THEN rank END, doc_id) AS rerank_rank FROM j""",
    "k06_ensemble": f"{_SCORED} SELECT query_id, doc_id, chunk_id, (pair_score + other) / 2 AS pair_score FROM sc",
    "k08_table": f"""{_K2}, k2s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {_words('question', 'body')} DESC, doc_id) AS rank FROM k2), gold AS (SELECT query_id, count(*) AS g FROM rels GROUP BY ALL),
      hr AS (SELECT r.query_id, t.rank FROM rels r JOIN k2s t ON t.query_id = r.query_id AND t.doc_id = r.doc_id AND t.rank <= 5), k AS (SELECT g.query_id, g, count(h.rank) AS n, min(h.rank) AS f, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg FROM gold g LEFT JOIN hr h ON h.query_id = g.query_id GROUP BY g.query_id, g)
      SELECT 'PASS' AS state, round(avg(n / g::DOUBLE), 6) AS recall, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(g, 5) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, count(*) AS n_queries FROM k""",
    "l11_by_fixed": f"""{_FEAT}, fx AS (SELECT query_id, doc_id, rrf_score, {_FINAL.replace('bm25_pyvi_rank', 'pyvi_bm25_rank').replace('(bm25_rank', '(raw_bm25_rank').replace('+ bm25_rank', '+ raw_bm25_rank')} AS s FROM feat),
      ftop AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN s = 0 THEN rrf_score ELSE s END, 9) DESC, doc_id) AS rank FROM fx QUALIFY rank <= 5),
      gold AS (SELECT query_id, count(*) AS g FROM rels WHERE query_id IN (SELECT query_id FROM ftop) GROUP BY ALL), len AS (SELECT query_id, count(*) AS n FROM ftop GROUP BY ALL),
      hit AS (SELECT t.query_id, t.rank FROM ftop t JOIN rels r ON r.query_id = t.query_id AND r.doc_id = t.doc_id), pq AS (SELECT g.query_id, g, n, count(h.rank) AS h5, coalesce(1.0 / min(h.rank), 0) AS mrr FROM gold g LEFT JOIN len l USING (query_id) LEFT JOIN hit h ON h.query_id = g.query_id GROUP BY g.query_id, g, n)
      SELECT round(avg(h5 / g::DOUBLE), 6) AS recall, round(avg(coalesce(h5 / n::DOUBLE, 0)), 6) AS precision, round(avg(mrr), 6) AS mrr, count(*) AS n_queries FROM pq""",
}
SQL["l07_predeclared"] = f"SELECT 'fixed' AS ranking, recall, precision FROM ({SQL['l11_by_fixed']})"
_TOKEN_PACKS = f"""{_chosen(2)}, {_LABELS}, tp AS (SELECT p.*, nullif(p.article, '') AS a1, CASE WHEN c.clause <> '' AND NOT contains(p.article, c.clause) THEN c.clause END AS c1, CASE WHEN c.point <> '' AND NOT contains(p.article, c.point) THEN c.point END AS p1
    FROM part p JOIN (SELECT chunk_id, any_value(clause) AS clause, any_value(point) AS point FROM info GROUP BY chunk_id) c USING (chunk_id)),
  tq AS (SELECT *, concat_ws(', ', a1, c1, p1) AS prefix, greatest(100, 480 - length(head) - n * 15) AS room FROM tp),
  tr AS (SELECT *, CASE WHEN prefix <> '' AND NOT starts_with(body, prefix) THEN prefix || ': ' || body ELSE body END AS content, {_SHARE} AS lim FROM tq),
  ts AS (SELECT query_id, doc_id, any_value(head) || ' ' || string_agg('[EVIDENCE ' || i || '] ' || {_cut('content', 'lim')}, ' ' ORDER BY i) AS pack FROM tr GROUP BY ALL),
  tw AS (SELECT *, list_filter(regexp_split_to_array(pack, '{X.WS}+'), lambda w: w <> '') AS words FROM ts)"""
SQL["e05_token_packs"] = f"{_TOKEN_PACKS} SELECT query_id, doc_id, CASE WHEN len({P.word_tokens('pack')}) > 120 AND len(words) > 108 THEN array_to_string(words[1:108], ' ') || '...' ELSE pack END AS pack FROM tw"
