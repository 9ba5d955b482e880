"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.skew import salted_join
from siltstone.plans import sqlparts as P
from siltstone.sources import canonical as C
from siltstone.sources.tables import table


def _q(expr):
    return lambda s, d: C.questions(s, d).select("query_id", expr(F.col("question_raw")).alias("value"))


def _sq(expr: str) -> str:
    return f"{P.with_tables('qs')} SELECT query_id, {expr} AS value FROM qs"


def f02_block_text(s, d):
    return C.docs(s, d).select("doc_id", F.md5(X.block(F.col("passage_raw"))).alias("digest"))


def f05_unaccented(s, d):
    return C.docs(s, d).select("doc_id", X.unaccented(F.col("title")).alias("value"))


def f06_pretty_title(s, d):
    return C.docs(s, d).select("doc_id", X.pretty_title(F.col("name_raw")).alias("value"))


KINDS = ("doc_numbers", "articles", "clauses", "points", "years")


def _listed(df, key, column):
    return df.select(key, X.signals(F.col(column)).alias("s")).select(key, *[F.array_join(F.col(f"s.{k}"), "|").alias(k) for k in KINDS])


def f07_legal_signals(s, d):
    return _listed(C.questions(s, d), "query_id", "question_raw")


def f07_chunk_signals(s, d):
    return _listed(C.chunks(s, d), "chunk_id", "text_raw")


def f08_metadata(s, d):
    return C.docs(s, d).select("doc_id", X.metadata(F.col("doc_id"), F.col("name_raw"), F.col("link"), F.col("passage_raw")).alias("m")).select("doc_id", "m.*")


def _tokens(c):
    return F.struct(F.size(c).cast("bigint").alias("n_tokens"), F.md5(F.array_join(c, " ")).alias("digest"))


def f09_legal_tokens(s, d):
    return C.chunks(s, d).select("chunk_id", _tokens(X.legal_tokens(F.col("text_norm"))).alias("t")).select("chunk_id", "t.*")


def f10_segmented_tokens(s, d):
    return C.chunks(s, d).select("chunk_id", _tokens(X.segmented_tokens(F.col("text_norm"))).alias("t")).select("chunk_id", "t.*")


def f14_truncated(s, d):
    return C.docs(s, d).select("doc_id", X.truncated(X.clean(F.col("document_text")), F.lit(120)).alias("value"))


def f15_unit_vectors(s, d):
    e = table(s, d, "embeddings")
    u = X.unit_vector(F.col("embedding"))
    return e.select("vec_id", F.round(X.norm(F.col("embedding")), 5).alias("length"), F.round(X.norm(u), 6).alias("unit_length"), F.round(F.get(u, F.lit(0)), 5).alias("first"))


def f16_slug(s, d):
    return C.docs(s, d).select("doc_id", F.replace(X.slug(F.col("link")), F.lit("-"), F.lit(" ")).alias("value"))


def f17_safe_number(s, d):
    t = table(s, d, "static_candidates")
    x = X.safe_number(F.col("score"), -1.0)
    return t.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 2).alias("total"), F.sum((x == -1).cast("bigint")).alias("n_default"))


def f18_sigmoid(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.round(X.sigmoid(F.col("value")), 6).alias("value"))


def f19_content_hash(s, d):
    """Documents of equal content: each with its group's digest, size and smallest id."""
    h = C.docs(s, d).select("doc_id", X.block(F.col("passage_raw")).alias("t")).filter("t != ''").select("doc_id", X.content_hash(F.col("t")).alias("h"))
    g = h.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
    return salted_join(h, g, ["h"], ["doc_id"]).select("doc_id", "h", "n", "first")


def f20_ordered_digest(s, d):
    return C.chunks(s, d).filter("doc_id is not null").groupBy("doc_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("chunk_id")), ","), 256).alias("digest"))


def f21_distinct_ids(s, d):
    t = table(s, d, "doc_disjoint_split")
    return t.select("split_id", F.array_join(F.array_distinct(F.filter("train_doc_ids", lambda x: x.isNotNull())), ",").alias("ids"))


QUERIES = {
    "f01_clean_text": _q(X.clean), "f02_block_text": f02_block_text, "f03_folded_text": _q(X.folded), "f04_normal_question": _q(X.question), "f05_unaccented": f05_unaccented,
    "f06_pretty_title": f06_pretty_title, "f07_legal_signals": f07_legal_signals, "f07_chunk_signals": f07_chunk_signals, "f08_metadata": f08_metadata,
    "f09_legal_tokens": f09_legal_tokens, "f10_segmented_tokens": f10_segmented_tokens, "f11_word_tokens": _q(lambda c: F.array_join(X.word_tokens(c), " ")),
    "f12_token_set": _q(lambda c: F.array_join(X.token_set(c), " ")), "f13_dense_text": _q(X.dense_text), "f14_truncated": f14_truncated, "f15_unit_vectors": f15_unit_vectors,
    "f16_slug": f16_slug, "f17_safe_number": f17_safe_number, "f18_sigmoid": f18_sigmoid, "f19_content_hash": f19_content_hash, "f20_ordered_digest": f20_ordered_digest, "f21_distinct_ids": f21_distinct_ids,
}


def _signals(table: str, key: str, column: str) -> str:
    return f"""{P.with_tables(table)}, c AS (SELECT {key}, {P.clean(column)} AS x FROM {table})
      SELECT {key}, {', '.join(f"array_to_string({getattr(P, k)('x')}, '|') AS {k}" for k in KINDS)} FROM c"""


def _hashed(tokens: str) -> str:
    return f"{P.with_tables('cks')}, t AS (SELECT chunk_id, {tokens} AS w FROM cks) SELECT chunk_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM t"


_UNSLUG = "trim(replace(regexp_replace({0}, '-\\d+$', ''), '-', ' '))"
_META = f"""{P.with_tables('docs')},
  m AS (SELECT doc_id, coalesce(name_raw, '') AS name, coalesce(link, '') AS link, left(coalesce(passage_raw, ''), 2000) AS start FROM docs),
  t AS (SELECT *, CASE WHEN name <> '' THEN {_UNSLUG.format('name')} WHEN link <> '' THEN {_UNSLUG.format(P.slug('link'))} ELSE 'Văn bản pháp luật ' || doc_id END AS title FROM m),
  k AS (SELECT *, coalesce(nullif(regexp_extract(start, '(?i){P.B0}({X.TYPE_WORDS}){P.B1}', 1), ''), nullif(regexp_extract(title, '(?i){P.B0}({X.TYPE_WORDS}){P.B1}', 1), ''), 'Văn bản') AS kind FROM t)
  SELECT doc_id, title, coalesce(nullif(regexp_extract(start, '(?i)(?:Số|Số\\s*:)\\s*([0-9]+(?:/[0-9]+)?(?:/[A-ZĐ0-9\\-_]+)?)', 1), ''), replace(nullif(regexp_extract(name, '{X.NUMBER_IN_NAME}', 1), ''), '-', '/')) AS legal_number,
    coalesce(nullif(regexp_extract(start, '{P.B0}(19[89]\\d|20[012]\\d){P.B1}', 1), ''), nullif(regexp_extract(name, '{P.B0}(19[89]\\d|20[012]\\d){P.B1}', 1), '')) AS year,
    upper(left(kind, 1)) || lower(substr(kind, 2)) AS doc_type FROM k"""
_TRUNC = """CASE WHEN length(x) <= 120 THEN x ELSE rtrim(CASE WHEN contains(left(x, 117), ' ') AND 117 - strpos(reverse(left(x, 117)), ' ') > 58
  THEN left(x, CAST(117 - strpos(reverse(left(x, 117)), ' ') AS INT)) ELSE left(x, 117) END) || '...' END"""
SQL = {
    "f01_clean_text": _sq(P.clean("question_raw")),
    "f02_block_text": f"{P.with_tables('docs')} SELECT doc_id, md5({P.block('passage_raw')}) AS digest FROM docs",
    "f03_folded_text": _sq(P.folded("question_raw")),
    "f04_normal_question": _sq(P.question("question_raw")),
    "f05_unaccented": f"{P.with_tables('docs')} SELECT doc_id, {P.unaccented('title')} AS value FROM docs",
    "f06_pretty_title": f"{P.with_tables('docs')} SELECT doc_id, {P.pretty_title('name_raw')} AS value FROM docs",
    "f07_legal_signals": _signals("qs", "query_id", "question_raw"),
    "f07_chunk_signals": _signals("cks", "chunk_id", "text_raw"),
    "f08_metadata": _META,
    "f09_legal_tokens": _hashed(P.legal_tokens("text_norm")),
    "f10_segmented_tokens": _hashed(P.found(f"lower({P.clean('text_norm')})", X.WORD)),
    "f11_word_tokens": _sq(f"array_to_string({P.word_tokens('question_raw')}, ' ')"),
    "f12_token_set": f"{P.with_tables('qs')}, t AS (SELECT query_id, list_filter(list_transform({P.found(P.folded('question_raw'), '[a-zà-ỹ0-9_/-]+')}, lambda e: trim(e, '/-')), lambda e: e <> '') AS w FROM qs) SELECT query_id, array_to_string({P.distinct('w')}, ' ') AS value FROM t",
    "f13_dense_text": _sq(f"trim({P.rep(P.nfc('question_raw'), X.WS + '+', ' ')})"),
    "f14_truncated": f"{P.with_tables('docs')}, c AS (SELECT doc_id, {P.clean('document_text')} AS x FROM docs) SELECT doc_id, {_TRUNC} AS value FROM c",
    "f15_unit_vectors": "SELECT vec_id, round(n, 5) AS length, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS unit_length, round(CASE WHEN n > 0 THEN embedding[1]::DOUBLE / n ELSE 0 END, 5) AS first FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS n FROM embeddings)",
    "f16_slug": f"{P.with_tables('docs')} SELECT doc_id, replace({P.slug('link')}, '-', ' ') AS value FROM docs",
    "f17_safe_number": "SELECT branch, count(*) AS n, round(sum(CASE WHEN isfinite(score) THEN score::DOUBLE ELSE -1 END), 2) AS total, CAST(sum(CASE WHEN isfinite(score) AND score <> -1 THEN 0 ELSE 1 END) AS BIGINT) AS n_default FROM static_candidates GROUP BY branch",
    "f18_sigmoid": "SELECT event_id, round(CASE WHEN value >= 50 THEN 1 WHEN value <= -50 THEN 0 ELSE 1 / (1 + exp(-value)) END, 6) AS value FROM events",
    "f19_content_hash": f"{P.with_tables('docs')}, t AS (SELECT doc_id, {P.block('passage_raw')} AS x FROM docs), g AS (SELECT doc_id, sha256(x) AS h, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM t WHERE x <> '' WINDOW w AS (PARTITION BY sha256(x))) SELECT doc_id, h, n, first FROM g WHERE n > 1",
    "f20_ordered_digest": f"{P.with_tables('cks')}, t AS (SELECT DISTINCT {P.given('document_id')} AS doc_id, chunk_id FROM cks) SELECT doc_id, sha256(string_agg(chunk_id, ',' ORDER BY chunk_id)) AS digest FROM t WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "f21_distinct_ids": f"SELECT split_id, array_to_string({P.distinct('w')}, ',') AS ids FROM (SELECT split_id, list_filter(train_doc_ids, lambda e: e IS NOT NULL) AS w FROM doc_disjoint_split)",
}
