"""Queries on the exact, dense and question-memory branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import exact as E
from siltstone.operators import memory as M
from siltstone.operators import vectors as V
from siltstone.plans import sqlparts as P
from siltstone.plans.retrieval import rolled
from siltstone.sources import canonical as C
from siltstone.sources.tables import table
from siltstone.storage import new_path, settled

TOP_K, DENSE = 10, 0.8


def _queries(s, d):
    return C.search_set(C.questions(s, d)).select("query_id", F.col("question_raw").alias("question"))


def _vectors(s, d):
    # Ten neighbouring vectors stand for the chunks of one document.
    e = table(s, d, "embeddings")
    base = e.select(F.col("vec_id").cast("string").alias("id"), F.floor(F.col("vec_id") / 10).cast("string").alias("doc_id"), F.col("embedding").alias("v"))
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v")), base


def j07_vector_join(s, d):
    q, base = _vectors(s, d)
    unit = lambda df: df.select("id", X.unit_vector(F.col("v")).alias("v"))
    return V.nearest(unit(q), unit(base), 20).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "chunk_rank")


def r08_dense(s, d):
    q, base = _vectors(s, d)
    got = V.dense_search(q, base, TOP_K)
    return got.select("query_id", "doc_id", *[F.round(c, 5).alias(c) for c in ("score", "best_score", "second_score", "mean_score")], "best_chunk_id", "rank")


def r09_hashed_vectors(s, d):
    return V.hashed_vectors(C.docs(s, d).select(F.col("doc_id").alias("id"), X.folded(F.concat_ws(" ", "title", "legal_number", "doc_type")).alias("text"))).select("id", "bucket", F.round("w", 6).alias("w"))


def r10_number_index(s, d):
    return E.number_index(C.docs(s, d))


def r10_title_index(s, d):
    return E.title_index(C.docs(s, d))


def j04_titles_inside(s, d):
    q = C.questions(s, d).select("query_id", F.lit(True).alias("bare"), X.unaccented(F.col("question_raw")).alias("text"))
    t = E.title_index(C.docs(s, d)).filter("bare").withColumn("title", F.element_at(F.split(F.col("title"), " ve "), -1)).filter(F.length("title") >= E.LEAST)
    return E.contained(q, t).select("query_id", "title")


def _asked(s, d):
    """All questions, and a question after each act whose id is divisible by 50."""
    docs = C.search_set(C.docs(s, d), "doc_id")
    text = F.concat(F.lit("Theo "), F.col("title"), F.lit(" số "), F.coalesce("legal_number", F.lit("")), F.lit(" năm "), F.coalesce("year", F.lit("")), F.lit(", Điều 1 khoản 1 điểm a quy định gì?"))
    return C.questions(s, d).select("query_id", F.col("question_raw").alias("question")).union(docs.select(F.concat(F.lit("d"), "doc_id"), text))


def r11_exact(s, d):
    got = E.match(_asked(s, d), C.docs(s, d), C.chunks(s, d))
    return got.select("query_id", "doc_id", *[F.col(k).cast("int").alias(k) for k in E.FLAGS if k != "exact_title_overlap"], F.round("exact_title_overlap", 6).alias("exact_title_overlap"), F.round("score", 6).alias("score"), "rank")


def j06_numbers(s, d):
    """Numbers asked for, found whole or, failing that, by the part from the first digit."""
    return E.number_seeds(_asked(s, d), C.docs(s, d)).select("query_id", "doc_id", "seed")


def _memory(s, d):
    rel = settled(C.relevant(s, d), "relevant")
    every = settled(C.questions(s, d).select("query_id", F.col("question_raw").alias("text")), "questions")
    return C.search_set(every), every.join(rel.select("query_id").distinct(), "query_id", "left_semi"), rel


def r13_gram_weights(s, d):
    _, train, _ = _memory(s, d)
    return M.weighted(*M.fitted(M.parted(train))).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.max("w"), 6).alias("heaviest"), F.round(F.sum("w"), 5).alias("total"))


def j08_similar_questions(s, d):
    q, train, _ = _memory(s, d)
    return M.similar(q, train, 0.5).select("query_id", "train_id", F.round("lexical", 5).alias("lexical"))


def r14_votes(s, d):
    q, train, rel = _memory(s, d)
    got = M.votes(M.similar(q, train, 0.5), rel, train.count(), TOP_K)
    return got.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.round("lexical_similarity", 5).alias("lexical_similarity"), "vote_count", "matched_id", F.round("positive_frequency", 8).alias("positive_frequency"), "rank")


def _both_arms(s, d):
    """Question memory by n-grams or by vectors; hashed n-grams of the question stand for an encoder."""
    q, train, rel = _memory(s, d)
    v = lambda df: V.dense_rows(V.hashed_vectors(df.select(F.col("query_id").alias("id"), X.folded(F.col("text")).alias("text"))))
    return M.both_arms(settled(M.similar(q, train, 0.5), "similar"), settled(v(q), "query-rows"), settled(v(train), "rows"), DENSE), train, rel


def j08_both_arms(s, d):
    return _both_arms(s, d)[0].select("query_id", "train_id", F.round("lexical", 5).alias("lexical"), F.round("dense", 5).alias("dense"))


def r14_both_arms(s, d):
    pairs, train, rel = _both_arms(s, d)
    got = M.votes(pairs, rel, train.count(), TOP_K)
    return got.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.round("lexical_similarity", 5).alias("lexical_similarity"), F.round("dense_similarity", 5).alias("dense_similarity"), "vote_count", "rank")


def s13_stored_memory(s, d):
    """Similar questions from a memory that was stored and read again."""
    q, train, _ = _memory(s, d)
    path = new_path(s, "memory")
    M.save(train, path)
    return M.similar(q, None, 0.5, M.load(s, path)).select("query_id", "train_id", F.round("lexical", 5).alias("lexical"))


def r07_encoded(s, d):
    """Vectors of an encoder over batches of texts; this one knows a text's length and its blanks."""
    texts = C.docs(s, d).select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("text"))
    return V.encoded(texts, lambda batch: [[len(t), t.count(" ")] for t in batch]).select("id", F.round(F.get("v", F.lit(0)), 6).alias("x"), F.round(F.get("v", F.lit(1)), 6).alias("y"))


def r12_exact_ranks(s, d):
    """The exact branch as a ranked list: at most ten documents a question by seed or composite score."""
    return E.match(_asked(s, d), C.docs(s, d), C.chunks(s, d), TOP_K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def r15_memory_rows(s, d):
    _, train, rel = _memory(s, d)
    return train.join(rel, "query_id").select("query_id", "doc_id")


QUERIES = {
    "j07_vector_join": j07_vector_join, "r08_dense": r08_dense, "r09_hashed_vectors": r09_hashed_vectors, "r10_number_index": r10_number_index, "r10_title_index": r10_title_index,
    "j04_titles_inside": j04_titles_inside, "j06_numbers": j06_numbers, "r11_exact": r11_exact, "r13_gram_weights": r13_gram_weights, "j08_similar_questions": j08_similar_questions, "r14_votes": r14_votes, "r15_memory_rows": r15_memory_rows,
    "j08_both_arms": j08_both_arms, "r14_both_arms": r14_both_arms, "s13_stored_memory": s13_stored_memory, "r07_encoded": r07_encoded, "r12_exact_ranks": r12_exact_ranks,
}

_NEAR = """WITH u AS MATERIALIZED (SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, CAST(vec_id // 10 AS VARCHAR) AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
  s AS (SELECT q.id AS query_id, b.id AS chunk_id, b.doc_id AS doc_id, list_dot_product(q.e, b.e) / (q.n * b.n) AS score FROM u q, u b WHERE q.vec_id % 50 = 0),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS chunk_rank FROM s) WHERE chunk_rank <= {k})"""


def _grams(x: str) -> str:
    w = f"list_transform(list_filter(regexp_split_to_array({x}, '{X.WS}+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
    return f"flatten(list_transform({w}, lambda w: flatten(list_transform([3, 4, 5], lambda n: CASE WHEN n = 3 OR length(w) > n - 1 THEN list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n)) ELSE [] END))))"


_TFIDF = f"""{P.with_tables('qs', 'rels')},
  train AS (SELECT query_id, {P.folded('question_raw')} AS text FROM qs WHERE query_id IN (SELECT query_id FROM rels)),
  sq AS (SELECT query_id, {P.folded('question_raw')} AS text FROM qs WHERE {P.id_number('query_id')} % 50 = 0),
  tf AS MATERIALIZED (SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest({_grams('text')}) AS g FROM train) GROUP BY ALL),
  qtf AS (SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest({_grams('text')}) AS g FROM sq) GROUP BY ALL),
  nn AS (SELECT count(*) AS n FROM train), df AS (SELECT g, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, nn GROUP BY g),
  tw AS (SELECT query_id, g, (1 + ln(tf)) * idf AS w FROM tf JOIN df USING (g)), qw AS (SELECT query_id, g, (1 + ln(tf)) * idf AS w FROM qtf JOIN df USING (g)),
  tv AS MATERIALIZED (SELECT query_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM tw), qv AS MATERIALIZED (SELECT query_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw),
  sim AS MATERIALIZED (SELECT q.query_id AS query_id, t.query_id AS train_id, sum(q.w * t.w) AS lexical FROM qv q JOIN tv t USING (g) WHERE q.query_id <> t.query_id GROUP BY ALL HAVING sum(q.w * t.w) >= 0.5 - 1e-9)"""
_DENSE = f"""{_TFIDF}, hx AS (SELECT query_id AS id, text AS x, 't' AS part FROM train UNION ALL SELECT query_id, text, 'q' FROM sq),
  hg AS (SELECT part, id, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n))))) AS g FROM hx),
  hc AS (SELECT part, id, CAST(('0x' || left(md5(g), 2)) AS INT) AS bucket, count(*) AS n FROM hg GROUP BY ALL), hv AS MATERIALIZED (SELECT part, id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY part, id)) AS w FROM hc),
  dn AS (SELECT a.id AS query_id, b.id AS train_id, sum(a.w * b.w) AS dense FROM hv a JOIN hv b ON a.part = 'q' AND b.part = 't' AND a.bucket = b.bucket AND a.id <> b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.8 - 1e-9),
  arms AS MATERIALIZED (SELECT query_id, train_id, lexical, dense FROM sim FULL JOIN dn USING (query_id, train_id))"""
_YEARLESS = lambda x: P.trim_white(P.rep(x, rf"(^|[^\p{{L}}\p{{N}}_])(19[89]\d|20[012]\d)\b", r"\1"))
_TITLES = f"""tt AS (SELECT doc_id, coalesce(nullif(title, ''), name_raw) AS t FROM docs),
  forms AS (SELECT doc_id, {P.folded('t')} AS title, false AS bare FROM tt UNION ALL SELECT doc_id, {P.unaccented('t')}, true FROM tt),
  titles AS (SELECT DISTINCT title, doc_id, bare FROM (SELECT * FROM forms UNION ALL SELECT doc_id, {_YEARLESS('title')}, bare FROM forms) WHERE length(title) >= 7)"""
_NUMS = f"""nums AS (SELECT doc_id, replace({P.folded('legal_number')}, '-', '/') AS number FROM docs), nidx AS (SELECT DISTINCT number, doc_id FROM (SELECT number, doc_id FROM nums UNION ALL SELECT regexp_replace(number, '^[^\\d]*', ''), doc_id FROM nums) WHERE number <> '')"""
_ASKED = f"""asked AS (SELECT DISTINCT query_id, unnest(list_concat(list_transform({P.found('question_raw', '(?i)(\\d+[/\\-][0-9]+[/\\-][A-ZĐa-z0-9\\-_]+|\\d+[/\\-][A-ZĐa-z0-9\\-_]+)', 1)}, lambda e: replace({P.folded('e')}, '-', '/')), list_transform({P.doc_numbers(P.clean('question_raw'))}, lambda e: replace(lower(e), '-', '/')))) AS number FROM qa),
  byn AS (SELECT query_id, doc_id, max(seed) AS seed FROM (SELECT query_id, doc_id, 1.0 AS seed FROM asked JOIN nidx USING (number)
    UNION ALL SELECT query_id, doc_id, 0.9 FROM (SELECT query_id, regexp_replace(number, '^[^\\d]*', '') AS number FROM asked WHERE number NOT IN (SELECT number FROM nidx)) JOIN nidx USING (number)) GROUP BY ALL)"""
_SETS = lambda x: P.distinct(f"list_filter(list_transform({P.found(P.folded(x), '[a-zà-ỹ0-9_/-]+')}, lambda e: trim(e, '/-')), lambda e: e <> '')")


def _hit(labels: str, signal: str, word: str) -> str:
    return f"coalesce(len(list_filter({labels}, lambda v: len(list_filter({signal}, lambda s: contains(v, '{word} ' || s) OR v = s)) > 0)) > 0, false)"


def _label(c: str, word: str, pattern: str) -> str:
    rest = f"regexp_replace({P.folded(c)}, '{pattern}', '')"
    return f"SELECT {P.given('document_id')} AS doc_id, '{word}' AS kind, unnest([{P.folded(c)}, CASE WHEN {rest} <> '' THEN '{word} ' || {rest} END]) AS v FROM cks"


_Q = P.clean("question_raw")
_ALL = f"""qa AS MATERIALIZED (SELECT query_id, question_raw FROM qs UNION ALL SELECT 'd' || doc_id, 'Theo ' || title || ' số ' || coalesce(legal_number, '') || ' năm ' || coalesce(year, '') || ', Điều 1 khoản 1 điểm a quy định gì?' FROM docs WHERE {P.id_number('doc_id')} % 50 = 0)"""
_EXACT = f"""{P.with_tables('docs', 'qs', 'cks')}, {_ALL}, {_TITLES}, {_NUMS}, {_ASKED},
  qf AS (SELECT query_id, {P.folded('question_raw')} AS text, false AS bare FROM qa UNION ALL SELECT query_id, {P.unaccented('question_raw')}, true FROM qa),
  byt AS (SELECT DISTINCT query_id, doc_id FROM qf JOIN titles t ON t.bare = qf.bare AND contains(text, title)),
  sig AS MATERIALIZED (SELECT query_id, list_transform({P.articles(_Q)}, lambda e: lower(e)) AS qa, list_transform({P.clauses(_Q)}, lambda e: lower(e)) AS qc, list_transform({P.points(_Q)}, lambda e: lower(e)) AS qp,
    {P.years(_Q)} AS qy, {P.doc_types('question_raw')} AS qt, {_SETS('question_raw')} AS tokens FROM qa),
  dated AS (SELECT doc_id, trim(year) AS year, {_YEARLESS(P.folded('title'))} AS title FROM docs),
  byy AS (SELECT DISTINCT query_id, doc_id FROM qf JOIN sig USING (query_id) JOIN dated ON NOT bare AND length(title) >= 7 AND contains(text, title) AND list_contains(qy, year)),
  seeds AS (SELECT query_id, doc_id, max(seed) AS seed, bool_or(n) AS n, bool_or(t) AS t, bool_or(y) AS y FROM (SELECT query_id, doc_id, seed, true AS n, false AS t, false AS y FROM byn UNION ALL SELECT query_id, doc_id, 0.85, false, true, false FROM byt UNION ALL SELECT query_id, doc_id, 0.95, false, true, true FROM byy) GROUP BY ALL),
  labs AS (SELECT doc_id, list(DISTINCT v) FILTER (kind = 'điều') AS a, list(DISTINCT v) FILTER (kind = 'khoản') AS c, list(DISTINCT v) FILTER (kind = 'điểm') AS p FROM ({_label('article', 'điều', '^[^\\d]*')} UNION ALL {_label('clause', 'khoản', '^[^\\d]*')} UNION ALL {_label('point', 'điểm', '^[^\\p{L}\\p{N}_]*')}) WHERE v <> '' GROUP BY doc_id),
  flags AS (SELECT query_id, s.doc_id, seed, n AS exact_legal_number, coalesce(len(list_intersect(tk, tokens)) / nullif(len(tk), 0)::DOUBLE, 0) AS exact_title_overlap, t, {_hit('a', 'qa', 'điều')} AS exact_article, {_hit('c', 'qc', 'khoản')} AS exact_clause, {_hit('p', 'qp', 'điểm')} AS exact_point,
    y OR coalesce(list_contains(qy, trim(year)), false) AS exact_year, coalesce({P.folded('doc_type')} <> '' AND list_contains(qt, {P.folded('doc_type')}), false) AS exact_doc_type
    FROM seeds s JOIN sig USING (query_id) LEFT JOIN (SELECT *, {_SETS("coalesce(nullif(title, ''), name_raw)")} AS tk FROM docs) d ON d.doc_id = s.doc_id LEFT JOIN labs l ON l.doc_id = s.doc_id),
  scored AS (SELECT *, greatest(seed, 3.0 * exact_legal_number::INT + 1.5 * exact_title::INT + exact_title_overlap + exact_article::INT + 0.5 * exact_clause::INT + 0.5 * exact_point::INT + 0.5 * exact_year::INT + 0.5 * exact_doc_type::INT) AS score FROM (SELECT *, t OR exact_title_overlap > 0.6 AS exact_title FROM flags))"""
SQL = {
    "j07_vector_join": f"{_NEAR.format(k=20)} SELECT query_id, chunk_id, round(score, 5) AS score, chunk_rank FROM near",
    "r08_dense": f"{_NEAR.format(k=6 * TOP_K)}, " + f"{rolled('near', TOP_K)} SELECT query_id, doc_id, round(score, 5) AS score, round(best_score, 5) AS best_score, round(second_score, 5) AS second_score, round(mean_score, 5) AS mean_score, best_chunk_id, rank FROM ranked",
    "r09_hashed_vectors": f"""{P.with_tables('docs')}, t AS (SELECT doc_id AS id, {P.folded("concat_ws(' ', title, legal_number, doc_type)")} AS x FROM docs),
      g AS (SELECT id, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n))))) AS g FROM t),
      c AS (SELECT id, CAST(('0x' || left(md5(g), 2)) AS INT) AS bucket, count(*) AS n FROM g GROUP BY ALL) SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS w FROM c""",
    "r10_number_index": f"{P.with_tables('docs')}, {_NUMS} SELECT number, doc_id FROM nidx",
    "r10_title_index": f"{P.with_tables('docs')}, {_TITLES} SELECT title, doc_id, bare FROM titles",
    "j04_titles_inside": f"""{P.with_tables('docs', 'qs')}, {_TITLES}, sub AS (SELECT DISTINCT list_last(string_split(title, ' ve ')) AS title FROM titles WHERE bare)
      SELECT query_id, title FROM (SELECT query_id, {P.unaccented('question_raw')} AS text FROM qs) JOIN sub ON length(title) >= 7 AND contains(text, title)""",
    "j06_numbers": f"{P.with_tables('docs', 'qs')}, {_ALL}, {_NUMS}, {_ASKED} SELECT query_id, doc_id, seed::DOUBLE AS seed FROM byn",
    "r11_exact": f"""{_EXACT} SELECT query_id, doc_id, exact_legal_number::INT AS exact_legal_number, exact_title::INT AS exact_title, exact_article::INT AS exact_article, exact_clause::INT AS exact_clause, exact_point::INT AS exact_point, exact_year::INT AS exact_year,
      exact_doc_type::INT AS exact_doc_type, round(exact_title_overlap, 6) AS exact_title_overlap, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored""",
    "r13_gram_weights": f"{_TFIDF} SELECT query_id, count(*) AS n_grams, round(max(w), 6) AS heaviest, round(sum(w), 5) AS total FROM tv GROUP BY ALL",
    "j08_similar_questions": f"{_TFIDF} SELECT query_id, train_id, round(lexical, 5) AS lexical FROM sim",
    "r14_votes": f"""{_TFIDF}, v AS (SELECT s.query_id, doc_id, sum(lexical) AS score, max(lexical) AS lexical_similarity, count(*) AS vote_count, first(train_id ORDER BY round(lexical, 9) DESC, train_id) AS matched_id, count(*) / any_value(n) AS positive_frequency
      FROM sim s JOIN rels r ON r.query_id = s.train_id, nn GROUP BY s.query_id, doc_id)
      SELECT query_id, doc_id, round(score, 5) AS score, round(lexical_similarity, 5) AS lexical_similarity, vote_count, matched_id, round(positive_frequency, 8) AS positive_frequency, rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM v) WHERE rank <= {TOP_K}""",
    "j08_both_arms": f"{_DENSE} SELECT query_id, train_id, round(lexical, 5) AS lexical, round(dense, 5) AS dense FROM arms",
    "r14_both_arms": f"""{_DENSE}, v AS (SELECT s.query_id, doc_id, sum(coalesce(lexical, 0) + coalesce(dense, 0)) AS score, max(coalesce(lexical, 0)) AS lexical_similarity, max(coalesce(dense, 0)) AS dense_similarity, count(*) AS vote_count FROM arms s JOIN rels r ON r.query_id = s.train_id GROUP BY s.query_id, doc_id)
      SELECT query_id, doc_id, round(score, 5) AS score, round(lexical_similarity, 5) AS lexical_similarity, round(dense_similarity, 5) AS dense_similarity, vote_count, rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM v) WHERE rank <= {TOP_K}""",
    "s13_stored_memory": f"{_TFIDF} SELECT query_id, train_id, round(lexical, 5) AS lexical FROM sim",
    "r07_encoded": f"""{P.with_tables('docs')}, t AS (SELECT doc_id AS id, length(coalesce(title, ''))::DOUBLE AS a, (length(coalesce(title, '')) - length(replace(coalesce(title, ''), ' ', '')))::DOUBLE AS b FROM docs)
      SELECT id, round(coalesce(a / nullif(sqrt(a * a + b * b), 0), 0), 6) AS x, round(coalesce(b / nullif(sqrt(a * a + b * b), 0), 0), 6) AS y FROM t""",
    "r12_exact_ranks": f"{_EXACT} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= {TOP_K}",
    "r15_memory_rows": f"{P.with_tables('qs', 'rels')} SELECT query_id, doc_id FROM rels WHERE query_id IN (SELECT query_id FROM qs)",
}
