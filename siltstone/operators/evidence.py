"""Evidence: the chunks of a document that answer a query, and the text a reranker reads.

Term overlap is a join of query terms with chunk terms, like a posting lookup;
signals and phrases are column expressions.  A document's chunks are then few,
so the choice of complementary chunks folds over one sorted array a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.ranking import steady

SAME = 0.85
#: Looser signal patterns inside chunk labels and the start of a body.
LABEL = {"articles": r"(?iuU)\bđiều\s+(\d+[a-zA-Z]?)", "clauses": r"(?iuU)\bkhoản\s+(\d+[a-zA-Z]?)", "points": r"(?iuU)\bđiểm\s+([a-zA-Z\d]+)"}
START = 600


def chunk_info(chunks: DataFrame) -> DataFrame:
    """Chunks with body, tokens and the numbers in their labels and the start of their body."""
    body = X.shown(F.coalesce(F.when(F.col("text_raw") != "", F.col("text_raw")), F.col("text_norm")))
    label = {"articles": "article", "clauses": "clause", "points": "point"}
    c = chunks.select("doc_id", "chunk_id", *[X.shown(F.col(x)).alias(x) for x in ("article", "clause", "point")], body.alias("body"))

    def numbers(k: str) -> Column:
        return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(LABEL[k]), F.lit(1)) for t in (F.lower(label[k]), F.lower(F.left("body", F.lit(START))))]))

    return c.select("*", X.word_tokens(F.col("body")).alias("tokens"), *[numbers(k).alias(k) for k in LABEL])


def chunk_terms(info: DataFrame) -> DataFrame:
    """``chunk_id, term, tf``: tokens of the body once, of the article label twice."""
    rows = info.select("chunk_id", F.explode(F.concat(F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"))), F.transform(X.word_tokens(F.col("article")), lambda t: F.struct(t.alias("term"), F.lit(2).alias("n"))))).alias("x"))
    return rows.groupBy("chunk_id", F.col("x.term").alias("term")).agg(F.sum("x.n").alias("tf"))


def query_info(queries: DataFrame) -> DataFrame:
    """Tokens, signals and three-word phrases of ``query_id, question``."""
    x = X.clean(F.col("question"))
    tokens = X.word_tokens(x)
    low = lambda a: F.transform(a, F.lower)
    q = queries.select("query_id", tokens.alias("q_tokens"), low(X.articles(x)).alias("q_articles"), low(X.clauses(x)).alias("q_clauses"), low(X.points(x)).alias("q_points"), low(X.doc_numbers(x)).alias("q_numbers"), X.years(x).alias("q_years"))
    phrases = F.when(F.size("q_tokens") >= 3, F.transform(F.sequence(F.lit(1), F.size("q_tokens") - 2), lambda i: F.array_join(F.slice("q_tokens", i, F.lit(3)), " "))).otherwise(F.array().cast("array<string>"))
    return q.withColumn("q_phrases", phrases)


#: The points of ``signal_score``: articles 20, 18, 12; clauses 8, 5; points 4, 3; numbers 6; years 1.5; phrases 2.5 each; prior chunk 5.
def _tiers(*pairs: tuple[Column, float]) -> Column:
    out = F.when(pairs[0][0], F.lit(pairs[0][1]))
    for test, value in pairs[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(0.0)


def signal_score(training: bool = False) -> Column:
    """Points for statutory signals, phrases and the prior best chunk, of rows with ``low``, the body in lower case; ``training`` leaves out years, phrases and the prior."""
    body, art = F.col("low"), F.lower("article")

    def some(signal: str, test) -> Column:
        return F.exists(signal, test)

    def inside(text: Column, word: str, v: Column) -> Column:
        return F.contains(text, F.concat(F.lit(word), v))

    s = _tiers((F.arrays_overlap("q_articles", "articles"), 20.0), (some("q_articles", lambda v: inside(art, "điều ", v) | (art == v)), 18.0), (some("q_articles", lambda v: inside(body, "điều ", v)), 12.0))
    s = s + _tiers((F.arrays_overlap("q_clauses", "clauses"), 8.0), (some("q_clauses", lambda v: inside(body, "khoản ", v) | F.contains(body, F.concat(v, F.lit(".")))), 5.0))
    s = s + _tiers((F.arrays_overlap("q_points", "points"), 4.0), (some("q_points", lambda v: inside(body, "điểm ", v) | F.contains(body, F.concat(v, F.lit(")")))), 3.0))
    s = s + _tiers((some("q_numbers", lambda v: F.contains(body, v)), 6.0))
    if not training:
        s = s + _tiers((some("q_years", lambda v: F.contains(body, v)), 1.5))
        s = s + 2.5 * F.size(F.filter("q_phrases", lambda v: F.contains(body, v)))
        s = s + _tiers((F.col("prior_chunk_id") == F.col("chunk_id"), 5.0))
    return s


def scored_chunks(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, training: bool = False) -> DataFrame:
    """Every chunk of every candidate document with its ``score``.

    ``candidates`` has ``query_id, doc_id`` and may have ``prior_chunk_id``;
    documents without chunks give no rows.
    """
    if "prior_chunk_id" not in candidates.columns:
        candidates = candidates.withColumn("prior_chunk_id", F.lit(None).cast("string"))
    wanted = chunks.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    info, q = chunk_info(wanted), query_info(queries)
    # Tokens follow from the body and would double what every shuffle of pairs carries.
    pairs = candidates.select("query_id", "doc_id", "prior_chunk_id").join(info.withColumn("n_tokens", F.size("tokens")).drop("tokens"), "doc_id")
    terms = q.select("query_id", F.explode("q_tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    hit = pairs.select("query_id", "chunk_id").distinct().join(terms, "query_id").join(chunk_terms(info), ["chunk_id", "term"])
    overlap = hit.groupBy("query_id", "chunk_id").agg(F.sum(F.col("qf") * (1 + F.ln(1 + F.col("tf")))).alias("overlap"))
    # Once a row: inside the tests it would be made again for every signal and phrase.
    r = pairs.join(q, "query_id").join(overlap, ["query_id", "chunk_id"], "left").withColumn("low", F.lower("body"))
    lexical = F.when(F.col("n_tokens") > 0, 2.0 * F.coalesce("overlap", F.lit(0.0)) / (F.sqrt("n_tokens") + 1)).otherwise(0.0)
    return r.select("query_id", "doc_id", "chunk_id", "article", "clause", "point", "body", (signal_score(training) + lexical).alias("score"))


def selected(scored: DataFrame, max_chunks: int, skip_empty: bool = True) -> DataFrame:
    """``query_id, doc_id, chunks``: up to ``max_chunks`` chunks, best first, no two of like words.

    Chunks go by falling score, then by id.  One is passed over if its word set
    is like that of a chosen one (Jaccard ``SAME`` or more), or, with
    ``skip_empty``, if it has no words; if too few are left, the passed-over
    ones fill up in order.  A document's only chunk is always chosen.
    """
    item = F.struct((-steady("score")).alias("s"), "chunk_id", "article", "clause", "point", "body", "score")
    g = scored.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    g = g.withColumn("all", F.transform("all", lambda x: x.withField("w", F.array_distinct(X.word_tokens(x["body"])))))
    none = F.slice("all", F.lit(1), F.lit(0))

    def alike(a: Column, b: Column) -> Column:
        same = F.size(F.array_intersect(a, b))
        return F.when(F.size(a) > 0, same / F.greatest(F.size(a) + F.size(b) - same, F.lit(1)) >= SAME).otherwise(False)

    def step(taken: Column, x: Column) -> Column:
        passed = F.exists(taken, lambda t: alike(t["w"], x["w"]))
        if skip_empty:
            passed = passed | (F.size(x["w"]) == 0)
        return F.when((F.size(taken) < max_chunks) & ~passed, F.concat(taken, F.array(x))).otherwise(taken)

    first = F.aggregate("all", none, step)
    rest = F.filter("all", lambda x: ~F.exists("first", lambda t: t["chunk_id"] == x["chunk_id"]))
    g = g.withColumn("first", F.when(F.size("all") == 1, F.col("all")).otherwise(first))
    return g.select("query_id", "doc_id", F.transform(F.slice(F.concat("first", rest), F.lit(1), F.lit(max_chunks)), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["article"].alias("article"), x["clause"].alias("clause"), x["point"].alias("point"), x["body"].alias("body"), x["score"].alias("score"))).alias("chunks"))


#: The markers [DOCUMENT], [EVIDENCE n], [VĂN BẢN], [ĐIỀU KHOẢN], [NỘI DUNG] and the stand-in texts of documents without a title.
def document_label(doc_id: Column, title: Column, name: Column, number: Column) -> Column:
    t = X.shown(title, X.shown(name, F.concat(F.lit("Văn bản "), doc_id)))
    n = X.shown(number)
    return F.when(n != "", F.trim(F.concat_ws(" ", t, n))).otherwise(t)


def packs(chosen: DataFrame, docs: DataFrame, max_chars: int = 1200, max_tokens: int | None = None, article_prefix: bool = False) -> DataFrame:
    """``query_id, doc_id, pack``: one line of document label and evidence within a budget of characters.

    The first of several chunks gets three fifths of the budget, at least 150;
    the others share the rest, at least 100 each.  With ``max_tokens`` the budget
    is four characters a token, and a longer pack is cut to nine tenths of the
    tokens.  ``chosen`` has ``query_id, doc_id, chunks``; no chunks give a line
    that names the document.
    """
    limit = min(max_chars, max_tokens * 4) if max_tokens else max_chars
    d = docs.select("doc_id", document_label(F.col("doc_id"), F.col("title"), F.col("name_raw"), F.col("legal_number")).alias("label"))
    head = F.concat(F.lit("[DOCUMENT] "), F.coalesce("label", F.concat(F.lit("Văn bản "), "doc_id")))
    kind = "array<struct<chunk_id:string,article:string,clause:string,point:string,body:string>>"
    bare = F.transform("chunks", lambda x: F.struct(*[x[c].alias(c) for c in ("chunk_id", "article", "clause", "point", "body")]))
    fallback = F.array(F.struct(F.concat("doc_id", F.lit("_fallback")).alias("chunk_id"), F.lit("").alias("article"), F.lit("").alias("clause"), F.lit("").alias("point"), F.concat(F.lit("Văn bản pháp luật "), "doc_id").alias("body"))).cast(kind)
    r = chosen.join(d, "doc_id", "left").withColumn("head", head)
    r = r.withColumn("items", F.when(F.size("chunks") > 0, bare.cast(kind)).otherwise(fallback))
    n, room = F.size("items"), F.greatest(F.lit(100), limit - F.length("head") - F.size("items") * 15)

    def content(x: Column) -> Column:
        body = F.trim(x["body"])
        if not article_prefix:
            return body

        def more(v: Column) -> Column:
            return F.when((v != "") & ~F.contains(x["article"], v), v)

        prefix = F.concat_ws(", ", F.when(x["article"] != "", x["article"]), more(x["clause"]), more(x["point"]))
        return F.when((prefix != "") & ~F.startswith(body, prefix), F.concat_ws(": ", prefix, body)).otherwise(body)

    def line(x: Column, i: Column) -> Column:
        share = F.when(n == 1, room).when(i == 0, F.greatest(F.lit(150), F.floor(room * 0.6))).otherwise(F.greatest(F.lit(100), F.floor(room * (0.4 / F.greatest(n - 1, F.lit(1)))))).cast("int")
        return F.concat(F.lit("[EVIDENCE "), (i + 1).cast("string"), F.lit("] "), X.truncated(content(x), share))

    pack = F.concat_ws(" ", F.array("head"), F.transform("items", line))
    r = r.withColumn("pack", pack)
    if max_tokens:
        words = F.filter(F.split("pack", X.WS + "+"), lambda w: w != "")
        most = int(max_tokens * 0.9)
        cut = F.concat(F.array_join(F.slice(words, F.lit(1), F.lit(most)), " "), F.lit("..."))
        r = r.withColumn("pack", F.when((F.size(X.word_tokens(F.col("pack"))) > max_tokens) & (F.size(words) > most), cut).otherwise(F.col("pack")))
    return r.select("query_id", "doc_id", "chunks", "label", "pack")


def records(packed: DataFrame, docs: DataFrame, max_chars: int = 1200) -> DataFrame:
    """One row for each evidence chunk: its reranker text, the pack, and the text with labels."""
    d = docs.select("doc_id", X.shown(F.col("title"), X.shown(F.col("name_raw"), F.concat(F.lit("Văn bản "), "doc_id"))).alias("title"), X.shown(F.col("legal_number")).alias("number"))
    r = packed.join(d, "doc_id", "left").select("*", F.posexplode("chunks").alias("i", "c"))
    body = F.trim(F.left(F.col("c.body"), F.lit(max_chars)))
    labelled = F.concat(labelled_header("title", "number"), F.lit("\n[ĐIỀU KHOẢN]: "), X.shown(F.col("c.article"), "Thông tin văn bản"), F.lit("\n[NỘI DUNG]:\n"), F.col("c.body"))
    return r.select(
        "query_id", "doc_id", F.col("c.chunk_id").alias("chunk_id"), (F.col("i") + 1).alias("n"), "pack", body.alias("chunk_text"),
        F.concat(F.lit("[DOCUMENT] "), "label", F.lit(" [EVIDENCE 1] "), body).alias("reranker_text"), F.when(F.col("i") == 0, F.concat_ws(" ", "pack", labelled)).otherwise(F.col("pack")).alias("text"),
    )


def labelled_header(title: str, number: str) -> Column:
    return F.concat(F.lit("[VĂN BẢN]: "), title, F.when(F.col(number) != "", F.concat(F.lit(" (Số: "), number, F.lit(")"))).otherwise(""))


def lines(chosen: DataFrame, docs: DataFrame, max_chars: int = 1200) -> DataFrame:
    """The same evidence on one line each, every body cut at ``max_chars``."""
    t = X.shown(F.col("title"), X.pretty_title(F.col("name_raw")))
    d = docs.select("doc_id", F.trim(F.concat_ws(" ", F.when(t != "", t), F.when(X.shown(F.col("legal_number")) != "", X.shown(F.col("legal_number"))))).alias("h"))
    r = chosen.join(d, "doc_id", "left").withColumn("h", F.when(F.coalesce("h", F.lit("")) == "", F.lit("Văn bản quy phạm pháp luật")).otherwise(F.col("h")))

    def line(x: Column, i: Column) -> Column:
        body = X.truncated(x["body"], F.lit(max_chars))
        shown = F.when((x["article"] != "") & ~F.startswith(body, x["article"]), F.concat_ws(": ", x["article"], body)).otherwise(body)
        return F.concat(F.lit("[EVIDENCE "), (i + 1).cast("string"), F.lit("] "), shown)

    some = F.when(F.size("chunks") > 0, F.transform("chunks", line)).otherwise(F.array(F.concat(F.lit("[EVIDENCE 1] "), "h")))
    return r.select("query_id", "doc_id", F.concat_ws("\n", F.array(F.concat(F.lit("[DOCUMENT] "), "h")), some).alias("text"))
