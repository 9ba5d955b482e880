"""Queries on the structure of acts and their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import structure as T
from siltstone.plans import sqlparts as P
from siltstone.sources import canonical as C


def _docs(s, d):
    return C.docs(s, d).select("doc_id", "title", "legal_number", F.col("passage_raw").alias("text"), "is_empty")


def t01_articles(s, d):
    return T.articles(_docs(s, d)).select("doc_id", "n", "chapter", "section", "article", "clause", F.md5("text_raw").alias("digest"))


def t02_units(s, d):
    return T.legal_units(_docs(s, d)).select("doc_id", "n", "chapter", "section", "article", "clause", "point", F.md5("text").alias("digest"))


def t03_windows(s, d):
    words = F.filter(F.split(X.clean(F.col("text")), " "), lambda w: w != "")
    rows = _docs(s, d).select("doc_id", words.alias("w")).select("doc_id", "w", F.posexplode(T.window_spans(F.size("w"), 300, 50)).alias("n", "x"))
    return rows.select("doc_id", "n", F.col("x.first").alias("first"), F.col("x.n_words").alias("n_words"), F.md5(F.array_join(F.slice("w", F.col("x.first") + 1, F.col("x.n_words")), " ")).alias("digest"))


def t04_chunks(s, d):
    return T.chunked(_docs(s, d)).select("chunk_id", "doc_id", "granularity", "article", "clause", "point", "parent_chunk_id", "token_count", "is_empty", F.md5("text_norm").alias("digest"))


def t05_budgets(s, d):
    b, n = T.Budgets(), T.header_words(F.coalesce("title", F.concat(F.lit("Văn bản pháp luật "), "doc_id")), F.col("legal_number"))
    room = lambda least, most, more: F.greatest(F.lit(least), most - (n + more))
    return _docs(s, d).select("doc_id", room(b.macro_min, b.macro_max, 2).alias("macro"), room(b.micro_min, b.micro_max, 2).alias("micro"), room(b.fallback_min, b.fallback_max, 2).alias("fallback"))


QUERIES = {"t01_articles": t01_articles, "t02_units": t02_units, "t03_windows": t03_windows, "t04_chunks": t04_chunks, "t05_budgets": t05_budgets}
_HEAD = f"len(regexp_extract_all('[VĂN BẢN]: ' || coalesce(title, 'Văn bản pháp luật ' || doc_id) || CASE WHEN coalesce(legal_number, '') <> '' THEN ' (Số: ' || legal_number || ')' ELSE '' END, '\\S+')) + 2"
_S = X.WS
_STRIP = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _split(x: str, heading: str) -> str:
    """A text cut before every line that is a heading; the first part stands before them all."""
    return f"string_split(regexp_replace({x}, '(?i)(^|\\n)({_S}*{heading})', chr(1) || '\\2', 'g'), chr(1))"


_LAST_OF = lambda x, heading: f"list_last(regexp_extract_all({x}, '(?i)(?:^|\\n){_S}*({heading})', 1))"
SQL = {
    "t01_articles": f"""{P.with_tables('docs')}, ln AS (SELECT doc_id, i, {_STRIP('a[i]')} AS l FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(passage_raw, ''), chr(10)) AS a FROM docs))),
      k AS (SELECT *, CASE WHEN regexp_matches(l, '(?i)^Chương{_S}+[IVXLCDM\\p{{Nd}}]+') THEN 'chapter' WHEN regexp_matches(l, '(?i)^Mục{_S}+\\p{{Nd}}+') THEN 'section' WHEN regexp_matches(l, '(?i)^Điều{_S}+\\p{{Nd}}+') THEN 'article' END AS kind FROM ln WHERE l <> ''),
      g AS (SELECT *, count(*) FILTER (kind = 'article') OVER w AS n, last_value(CASE WHEN kind = 'chapter' THEN l END IGNORE NULLS) OVER w AS ch, last_value(CASE WHEN kind = 'section' THEN l END IGNORE NULLS) OVER w AS se FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      r AS (SELECT doc_id, n, coalesce(arg_max_null(ch, i), '') AS chapter, coalesce(arg_max_null(se, i), '') AS section, min_by(l, i) AS article, coalesce('Khoản ' || max_by(regexp_extract(l, '^(\\p{{Nd}}+)\\.{_S}+[^\\n]+', 1), i) FILTER (kind IS NULL AND regexp_matches(l, '^\\p{{Nd}}+\\.{_S}+[^\\n]+')), '') AS clause, string_agg(l, chr(10) ORDER BY i) FILTER (kind IS NULL OR kind = 'article') AS t FROM g WHERE n > 0 GROUP BY doc_id, n)
      SELECT doc_id, n::INT AS n, chapter, section, article, clause, md5(t) AS digest FROM r
      UNION ALL SELECT doc_id, 1, '', '', 'Toàn văn', '', md5(passage_raw) FROM docs WHERE {_STRIP("coalesce(passage_raw, '')")} <> '' AND doc_id NOT IN (SELECT doc_id FROM r)""",
    "t02_units": f"""{P.with_tables('docs')}, a AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS k, p FROM (SELECT doc_id, {_split("coalesce(passage_raw, '')", f'Điều{_S}+[0-9]+[.:\\s][^\\n]*')} AS p FROM docs)),
      b AS (SELECT doc_id, k, {_STRIP('p[k]')} AS whole, regexp_replace(CASE WHEN k = 2 THEN p[1] ELSE chr(10) || regexp_replace(p[k - 1], '^{_S}*[^\\n]*\\n?', '') END, '', '') AS between FROM a),
      h AS (SELECT *, {_LAST_OF('between', f'Chương{_S}+[IVXLCDM0-9]+[^\\n]*')} AS ch, {_LAST_OF('between', f'Mục{_S}+[0-9]+[^\\n]*')} AS se FROM b WHERE k > 1),
      c AS (SELECT *, count(ch) OVER (PARTITION BY doc_id ORDER BY k) AS cg FROM h),
      x AS (SELECT doc_id, k, {_STRIP('last_value(ch IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k)')} AS chapter, {_STRIP('last_value(se IGNORE NULLS) OVER (PARTITION BY doc_id, cg ORDER BY k)')} AS section, {_STRIP("regexp_extract(whole, '^[^\\n]*')")} AS article, {_STRIP("regexp_replace(whole, '^[^\\n]*', '')")} AS body FROM c),
      y AS (SELECT *, {_split('body', f'[0-9]+\\.{_S}+[^\\n]*')} AS cl FROM x),
      z AS (SELECT doc_id, k, chapter, section, article, 0 AS j, NULL AS clause, CASE WHEN body <> '' THEN body ELSE article END AS t FROM y WHERE len(cl) = 1
        UNION ALL SELECT doc_id, k, chapter, section, article, j, 'Khoản ' || regexp_extract(cl[j], '^{_S}*([0-9]+)', 1), {_STRIP('cl[j]')} FROM (SELECT *, unnest(range(2, len(cl) + 1)) AS j FROM y WHERE len(cl) > 1)),
      q AS (SELECT *, CASE WHEN clause IS NULL THEN [t] ELSE {_split('t', f'[a-zđ]\\){_S}+[^\\n]*')} END AS po FROM z),
      u AS (SELECT doc_id, k, j, 0 AS m, chapter, section, article, clause, NULL AS point, t FROM q WHERE len(po) = 1
        UNION ALL SELECT doc_id, k, j, m, chapter, section, article, clause, 'Điểm ' || regexp_extract(po[m], '^{_S}*([a-zđA-ZĐ])\\)', 1), {_STRIP('po[m]')} FROM (SELECT *, unnest(range(2, len(po) + 1)) AS m FROM q WHERE len(po) > 1))
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j, m)::INT AS n, chapter, section, article, clause, point, md5(t) AS digest FROM u""",
    "t03_windows": f"""{P.with_tables('docs')}, t AS (SELECT doc_id, list_filter(string_split({P.clean('passage_raw')}, ' '), lambda w: w <> '') AS w FROM docs),
      s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 300 THEN [0] ELSE range(0, CAST(ceil((len(w) - 50) / 250.0) AS BIGINT)) END) AS n FROM t)
      SELECT doc_id, n, n * 250 AS first, least(len(w) - n * 250, 300) AS n_words, md5(array_to_string(w[n * 250 + 1:n * 250 + 300], ' ')) AS digest FROM s""",
    "t05_budgets": f"{P.with_tables('docs')} SELECT doc_id, greatest(400, 800 - ({_HEAD})) AS macro, greatest(100, 250 - ({_HEAD})) AS micro, greatest(700, 1200 - ({_HEAD})) AS fallback FROM docs",
}
