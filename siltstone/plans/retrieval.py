"""Queries on retrieval branches and the fusion of their results.

Searches take every query whose number is divisible by 50 against all chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import lexical as L
from siltstone.operators import ranking as R
from siltstone.plans import sqlparts as P
from siltstone.sources import canonical as C
from siltstone.sources.tables import table

TOP_K = 20


def _micro(s, d):
    return L.enriched(C.chunks(s, d).filter("granularity = 'micro'"), C.docs(s, d))


def _queries(s, d):
    return C.search_set(C.questions(s, d)).select("query_id", F.col("question_raw").alias("question"))


def r01_index_terms(s, d):
    i = L.build(_micro(s, d))
    return i.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).withColumn("idf", F.round(F.ln((i.n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6))


def _scored(s, d):
    return L.scores(L.build(_micro(s, d)), L.query_terms(_queries(s, d), "question"))


def r02_raw_scores(s, d):
    return _scored(s, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.max("raw_score"), 5).alias("best"), F.round(F.avg("raw_score"), 5).alias("mean"))


def r03_cut_off(s, d):
    return L.cut_off(_scored(s, d), TOP_K).select("query_id", "chunk_id", F.round("raw_score", 5).alias("raw_score"), "chunk_rank")


def _boosted(s, d):
    micro = _micro(s, d)
    return L.boosted(L.cut_off(_scored(s, d), TOP_K), micro, L.query_signals(_queries(s, d), "question"))


def r04_boosts(s, d):
    return _boosted(s, d).select("query_id", "chunk_id", F.round("boost", 4).alias("boost"), F.round("score", 5).alias("score"))


def r05_documents(s, d):
    got = L.documents(_boosted(s, d).filter("doc_id is not null"), TOP_K)
    return got.select("query_id", "doc_id", *[F.round(c, 5).alias(c) for c in ("score", "best_score", "second_score", "mean_score")], "best_chunk_id", "rank")


def r06_segmented(s, d):
    got = L.search(_micro(s, d), _queries(s, d), "question", TOP_K, L.SEGMENTED_WEIGHTS, X.segmented_tokens, None)
    return got.select("query_id", "doc_id", F.round("score", 5).alias("score"), "best_chunk_id", "rank")


def _ranks(s, d, depth=200):
    return R.branch_ranks(table(s, d, "static_candidates"), depth)


def r16_weighted_rrf(s, d):
    got = R.weighted_rrf(_ranks(s, d), {"bm25": 1.0, "dense": 1.2, "exact": 2.5}, limit=50)
    return got.select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")


def _chunk_scores(s, d):
    t = table(s, d, "static_candidates")
    x = F.col("score").cast("double")
    ok = t.filter("best_chunk_id is not null and query_id is not null").filter(~F.isnan(x) & (F.abs(x) != float("inf")))
    return ok.groupBy("query_id", F.col("best_chunk_id").alias("chunk_id")).agg(F.max(x).alias("score"))


def _aggregate(policy):
    def run(s, d):
        mapping = C.chunks(s, d).select("chunk_id", "doc_id").filter("doc_id is not null")
        return R.chunks_to_documents(_chunk_scores(s, d), mapping, policy, 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")

    return run


def r18_fused(s, d):
    got = R.fuse(_ranks(s, d), top_k=100)
    return got.select("query_id", "doc_id", F.round("rrf_score", 8).alias("rrf_score"), "source_count", *[F.coalesce(c, F.lit(999)).alias(c) for c in ("bm25_rank", "bm25_pyvi_rank", "dense_rank", "exact_rank")], "rank")


def r19_fused_runs(s, d):
    r = _ranks(s, d).filter("branch in ('bm25', 'bm25_pyvi', 'dense')")
    runs = r.select("query_id", "doc_id", F.col("rank").alias("position"), F.when(F.col("branch") == "bm25", 0).when(F.col("branch") == "bm25_pyvi", 1).otherwise(2).alias("run"))
    return R.fuse_runs(runs, n_runs=3).select("query_id", "doc_id", F.round("rrf_score", 8).alias("rrf_score"), "first_run", "rank")


def r20_injected(s, d):
    """Stored branches of all folds reused, cut at a smaller depth, without any of them computed anew."""
    return R.fuse(_ranks(s, d, 50).filter("branch != 'exact'"), top_k=20).select("query_id", "doc_id", F.round("rrf_score", 8).alias("rrf_score"), "rank")


QUERIES = {
    "r01_index_terms": r01_index_terms, "r02_raw_scores": r02_raw_scores, "r03_cut_off": r03_cut_off, "r04_boosts": r04_boosts, "r05_documents": r05_documents, "r06_segmented": r06_segmented,
    "r16_weighted_rrf": r16_weighted_rrf, "r17_chunks_max": _aggregate("max"), "r17_chunks_mean": _aggregate("mean"), "r18_fused": r18_fused, "r19_fused_runs": r19_fused_runs, "r20_injected": r20_injected,
}


def bm25_sql(weights: dict[str, float] = L.FIELD_WEIGHTS, tokens=P.legal_tokens) -> str:
    body = "CASE WHEN text_norm <> '' THEN text_norm ELSE text_raw END"
    cols = {"body": body, "legal_number": "legal_number", "title": "title", "article": "article", "clause": "clause", "slug": f"replace({P.slug('link')}, '-', ' ')"}
    parts = " UNION ALL ".join(f"SELECT chunk_id, {int(w)} AS w, unnest({tokens(cols[k])}) AS term FROM m" for k, w in weights.items() if int(w) > 0)
    return f"""{P.with_tables('docs', 'cks', 'qs')},
      m AS MATERIALIZED (SELECT c.chunk_id, {P.given('c.document_id')} AS doc_id, c.text_norm, c.text_raw, c.article, c.clause, c.point, d.title, d.legal_number, d.link, d.year, d.doc_type
        FROM cks c LEFT JOIN docs d ON d.doc_id = {P.given('c.document_id')} WHERE c.granularity = 'micro'),
      post AS MATERIALIZED (SELECT chunk_id, term, sum(w) AS tf FROM ({parts}) GROUP BY ALL),
      lens AS MATERIALIZED (SELECT m.chunk_id, doc_id, coalesce(len, 0) AS len FROM m LEFT JOIN (SELECT chunk_id, sum(tf) AS len FROM post GROUP BY ALL) x USING (chunk_id)),
      size AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
      dfs AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM post GROUP BY ALL),
      idfs AS (SELECT term, df, tf, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM dfs, size),
      sq AS (SELECT query_id, question_raw FROM qs WHERE {P.id_number('query_id')} % 50 = 0),
      qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('question_raw')}) AS term FROM sq) GROUP BY ALL),
      raw AS MATERIALIZED (SELECT query_id, p.chunk_id, doc_id, sum(idf * qtf * (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * (len / mean)))) AS raw_score
        FROM qt JOIN post p USING (term) JOIN idfs USING (term) JOIN lens l ON l.chunk_id = p.chunk_id, size GROUP BY ALL),
      cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 9) DESC, chunk_id) AS chunk_rank FROM raw) WHERE chunk_rank <= {max(10 * TOP_K, 100)})"""


def rolled(source: str, top_k: int) -> str:
    return f"""items AS (SELECT query_id, doc_id, list(struct_pack(s := -score, c := chunk_id) ORDER BY -score, chunk_id) AS i, avg(score) AS mean_score FROM {source} WHERE doc_id IS NOT NULL GROUP BY ALL),
      rolled AS (SELECT query_id, doc_id, -i[1].s + 0.1 * coalesce(-i[2].s, 0) AS score, -i[1].s AS best_score, coalesce(-i[2].s, 0) AS second_score, mean_score, i[1].c AS best_chunk_id FROM items),
      ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rolled) WHERE rank <= {top_k})"""


def _labelled(v: str, signal: str, word: str) -> str:
    return f"len(list_filter({signal}, lambda s: contains({v}, '{word} ' || s) OR contains({v}, '{word}_' || s) OR {v} = s)) > 0"


def _low(c: str) -> str:
    return f"lower(trim({P.nfc(c)}))"


_SIG = f"""sig AS (SELECT query_id, list_transform({P.doc_numbers(P.clean('question_raw'))}, lambda e: replace(lower(e), '-', '/')) AS q_numbers, list_transform({P.articles(P.clean('question_raw'))}, lambda e: lower(e)) AS q_articles,
  list_transform({P.clauses(P.clean('question_raw'))}, lambda e: lower(e)) AS q_clauses, list_transform({P.points(P.clean('question_raw'))}, lambda e: lower(e)) AS q_points,
  {P.years(P.clean('question_raw'))} AS q_years, {P.doc_types('question_raw')} AS q_types FROM sq)"""
_BOOST = f"""{_SIG},
  boosted AS (SELECT *, raw_score + boost AS score FROM (SELECT query_id, c.chunk_id, c.doc_id, raw_score,
    CASE WHEN {_low('legal_number')} <> '' AND len(list_filter(q_numbers, lambda n: contains(replace({_low('legal_number')}, '-', '/'), n))) > 0 THEN 6.0 ELSE 0 END
    + CASE WHEN {_labelled(_low('article'), 'q_articles', 'điều')} THEN 3.0 ELSE 0 END + CASE WHEN {_labelled(_low('clause'), 'q_clauses', 'khoản')} THEN 1.5 ELSE 0 END
    + CASE WHEN {_labelled(_low('point'), 'q_points', 'điểm')} THEN 0.75 ELSE 0 END + CASE WHEN list_contains(q_years, trim(coalesce(year, ''))) THEN 1.0 ELSE 0 END
    + CASE WHEN list_contains(q_types, {_low('doc_type')}) THEN 1.0 ELSE 0 END AS boost
    FROM cut c JOIN m USING (chunk_id) JOIN sig USING (query_id)))"""


def ranks_sql(depth: int = 200, also: str = "") -> str:
    return f"""WITH best AS (SELECT query_id, branch, doc_id, max(score::DOUBLE) AS score FROM static_candidates WHERE query_id IS NOT NULL AND branch IS NOT NULL AND doc_id IS NOT NULL AND isfinite(score) GROUP BY ALL),
      ranks AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= {depth} {also})"""


_WEIGHT = "CASE branch WHEN 'bm25' THEN 1.0 WHEN 'bm25_pyvi' THEN 1.0 WHEN 'dense' THEN 1.2 WHEN 'memory' THEN 2.0 WHEN 'exact' THEN 2.5 ELSE 1.0 END"
_FUSED = f"""fused AS (SELECT query_id, doc_id, sum({_WEIGHT} / (60 + rank)) AS rrf_score, count(DISTINCT branch) AS source_count, min(rank) FILTER (branch = 'bm25') AS bm25_rank, min(rank) FILTER (branch = 'bm25_pyvi') AS bm25_pyvi_rank,
  min(rank) FILTER (branch = 'dense') AS dense_rank, min(rank) FILTER (branch = 'exact') AS exact_rank FROM ranks GROUP BY ALL)"""


def ranked_sql(source: str, score: str, k: int | None = None, columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, doc_id) AS rank FROM {source}) {f'WHERE rank <= {k}' if k else ''}"


def _agg_sql(policy: str) -> str:
    return f"""{P.with_tables('cks')}, sc AS (SELECT query_id, best_chunk_id AS chunk_id, max(score::DOUBLE) AS score FROM static_candidates WHERE best_chunk_id IS NOT NULL AND query_id IS NOT NULL AND isfinite(score) GROUP BY ALL),
      mp AS (SELECT chunk_id, {P.given('document_id')} AS doc_id FROM cks), one AS (SELECT query_id, doc_id, {policy}(score) AS score FROM sc JOIN mp USING (chunk_id) WHERE doc_id IS NOT NULL GROUP BY ALL)
      {ranked_sql('one', 'score', 20, 'query_id, doc_id, round(score, 6) AS score, rank')}"""


SQL = {
    "r01_index_terms": f"{bm25_sql()} SELECT term, df, CAST(tf AS BIGINT) AS tf, round(idf, 6) AS idf FROM idfs",
    "r02_raw_scores": f"{bm25_sql()} SELECT query_id, count(*) AS n_chunks, round(max(raw_score), 5) AS best, round(avg(raw_score), 5) AS mean FROM raw GROUP BY ALL",
    "r03_cut_off": f"{bm25_sql()} SELECT query_id, chunk_id, round(raw_score, 5) AS raw_score, chunk_rank FROM cut",
    "r04_boosts": f"{bm25_sql()}, {_BOOST} SELECT query_id, chunk_id, round(boost::DOUBLE, 4) AS boost, round(score, 5) AS score FROM boosted",
    "r05_documents": f"{bm25_sql()}, {_BOOST}, {rolled('boosted', TOP_K)} SELECT query_id, doc_id, round(score, 5) AS score, round(best_score, 5) AS best_score, round(second_score, 5) AS second_score, round(mean_score, 5) AS mean_score, best_chunk_id, rank FROM ranked",
    "r06_segmented": f"{bm25_sql(L.SEGMENTED_WEIGHTS, lambda x: P.found(f'lower({P.clean(x)})', X.WORD))}, scored AS (SELECT *, raw_score AS score FROM cut), {rolled('scored', TOP_K)} SELECT query_id, doc_id, round(score, 5) AS score, best_chunk_id, rank FROM ranked",
    "r16_weighted_rrf": f"""{ranks_sql()}, one AS (SELECT query_id, doc_id, sum(CASE branch WHEN 'bm25' THEN 1.0 WHEN 'dense' THEN 1.2 ELSE 2.5 END / (60 + rank)) AS score FROM ranks WHERE branch IN ('bm25', 'dense', 'exact') GROUP BY ALL)
      {ranked_sql('one', 'score', 50, 'query_id, doc_id, round(score, 8) AS score, rank')}""",
    "r17_chunks_max": _agg_sql("max"),
    "r17_chunks_mean": _agg_sql("avg"),
    "r18_fused": f"{ranks_sql()}, {_FUSED} {ranked_sql('fused', 'rrf_score', 100, 'query_id, doc_id, round(rrf_score, 8) AS rrf_score, source_count, ' + ', '.join(f'coalesce({c}, 999) AS {c}' for c in ('bm25_rank', 'bm25_pyvi_rank', 'dense_rank', 'exact_rank')) + ', rank')}",
    "r19_fused_runs": f"""{ranks_sql()}, one AS (SELECT query_id, doc_id, sum(1.0 / 3 / (60 + rank)) AS rrf_score, min(CASE branch WHEN 'bm25' THEN 0 WHEN 'bm25_pyvi' THEN 1 ELSE 2 END) AS first_run FROM ranks WHERE branch IN ('bm25', 'bm25_pyvi', 'dense') GROUP BY ALL)
      {ranked_sql('one', 'rrf_score', None, 'query_id, doc_id, round(rrf_score, 8) AS rrf_score, first_run, rank')}""",
    "r20_injected": f"{ranks_sql(50, "AND branch <> 'exact'")}, {_FUSED} {ranked_sql('fused', 'rrf_score', 20, 'query_id, doc_id, round(rrf_score, 8) AS rrf_score, rank')}",
}
