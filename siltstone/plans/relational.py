"""Relational operators over the star schema and the retrieval tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import exact as E
from siltstone.operators import lexical as L
from siltstone.operators import metrics as M
from siltstone.operators.ranking import best
from siltstone.plans import sqlparts as P
from siltstone.sources import canonical as C
from siltstone.sources.tables import table


def q01_pricing(s, d):
    l = table(s, d, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")  # noqa: E741
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    g = l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(net).alias("sum_disc_price"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))
    return g.select("l_returnflag", "l_linestatus", *[F.round(c, 2).alias(c) for c in ("sum_qty", "sum_disc_price")], F.round("avg_disc", 6).alias("avg_disc"), "n")


def q03_top_orders(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    l = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))  # noqa: E741
    j = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", F.round("revenue", 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def q05_nations(s, d):
    c, o, l, u, n, r = (table(s, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(u, (l.l_suppkey == u.s_suppkey) & (c.c_nationkey == u.s_nationkey)).join(n, u.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def a02_distinct(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n"))


def a03_argmax(s, d):
    e = table(s, d, "events").filter("user_id is not null")
    return e.groupBy("user_id").agg(F.max(F.struct("value", "event_id"))["event_id"].alias("best_event"), F.round(F.max("value"), 4).alias("top"), F.round(F.avg("value"), 6).alias("mean"))


def a04_population_std(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 2).alias("std"))


def a06_pivot(s, d):
    t = table(s, d, "static_candidates")
    return t.groupBy("query_id").pivot("branch", ["bm25", "bm25_pyvi", "dense", "exact"]).agg(F.count(F.lit(1))).na.fill(0)


def a07_rollup(s, d):
    g = table(s, d, "part").rollup("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return g.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce(F.col("p_size").cast("string"), F.lit("all")).alias("size"), "n", "level")


def a08_approximate(s, d):
    """An approximate distinct count within five per cent of the exact one."""
    g = table(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("n"))
    return g.select((F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("close"), "n")


def w02_margin(s, d):
    w = Window.partitionBy("query_id", "branch").orderBy("rank")
    one = table(s, d, "static_candidates").filter("score is not null and not isnan(score) and abs(score) != double('Infinity')").groupBy("query_id", "branch", "doc_id").agg(F.max("score").alias("score"))
    top = best(one, ["query_id", "branch"], [F.desc("score"), F.asc("doc_id")], 2)
    return top.withColumn("margin", F.col("score") - F.lead("score").over(w)).filter("rank = 1").select("query_id", "branch", "doc_id", F.round(F.coalesce("margin", F.lit(0.0)), 5).alias("margin"))


def w03_running(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"), F.count(F.lit(1)).over(w).alias("n"))


def w04_second(s, d):
    one = table(s, d, "static_candidates").filter("score is not null and not isnan(score) and abs(score) != double('Infinity')").groupBy("query_id", "doc_id").agg(F.max(F.col("score").cast("double")).alias("score"))
    return best(one, ["query_id"], [F.desc("score"), F.asc("doc_id")], 2).filter("rank = 2").select("query_id", "doc_id", F.round("score", 5).alias("score"))


def w05_round_robin(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").filter("user_id is not null").select("event_id", "user_id", F.row_number().over(w).alias("round"))


def o01_sorted(s, d):
    return table(s, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


def o02_per_group(s, d):
    return best(table(s, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


def u01_union(s, d):
    a = table(s, d, "chunks").select(F.lit("chunks").alias("source"), "article")
    return a.unionByName(table(s, d, "macro_chunks").select(F.lit("macro").alias("source"), "article")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("article").alias("n_articles"))


def u02_intersect(s, d):
    return table(s, d, "macro_chunks").select("chunk_id").intersect(table(s, d, "chunks").select("chunk_id"))


def u03_except(s, d):
    return C.questions(s, d).select("query_id").exceptAll(C.relevant(s, d).select("query_id").distinct())


def u04_partition(s, d):
    t = table(s, d, "doc_disjoint_split")
    x = t.select(F.explode("train_doc_ids").alias("id"), F.lit(0).alias("side")).union(t.select(F.explode("val_doc_ids"), F.lit(1))).dropna().distinct()
    return x.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def j01_granularity(s, d):
    return C.chunks(s, d).groupBy("granularity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def j02_enriched(s, d):
    e = L.enriched(C.chunks(s, d), C.docs(s, d))
    return e.select("chunk_id", "doc_id", "title", "legal_number", "year")


def j05_title_year(s, d):
    """Acts whose subject, the last part of the title, is inside the title of another act of the year; titles are not compared pair by pair."""
    t = C.docs(s, d).filter("year is not null and title is not null").select("doc_id", "year", F.lower("title").alias("t"))
    subject = t.select("doc_id", "year", F.element_at(F.split("t", " về "), -1).alias("title")).filter(F.length("title") >= E.LEAST)
    within = E.contained(t.select(F.col("doc_id").alias("query_id"), F.lit(False).alias("bare"), F.col("t").alias("text")), subject.select("title", F.lit(False).alias("bare")))
    other = t.select(F.col("doc_id").alias("query_id"), F.col("year"))
    j = within.join(other, "query_id").join(subject, ["title", "year"]).filter("doc_id != query_id")
    return j.select("doc_id", F.col("query_id").alias("other_id"), "year")


def j10_anti(s, d):
    return C.docs(s, d).select("doc_id").join(C.relevant(s, d).select("doc_id"), "doc_id", "left_anti")


def j11_semi(s, d):
    return C.chunks(s, d).join(C.relevant(s, d).select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def j13_parents(s, d):
    return M.parent_documents(C.chunks(s, d)).groupBy("same").agg(F.count(F.lit(1)).alias("n"))


def j14_left(s, d):
    c = C.relevant(s, d).join(C.chunks(s, d).filter("granularity = 'macro'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left")
    return c.select("query_id", "doc_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


QUERIES = {
    "q01_pricing": q01_pricing, "q03_top_orders": q03_top_orders, "q05_nations": q05_nations, "a02_distinct": a02_distinct, "a03_argmax": a03_argmax, "a04_population_std": a04_population_std, "a06_pivot": a06_pivot, "a07_rollup": a07_rollup,
    "a08_approximate": a08_approximate, "w02_margin": w02_margin, "w03_running": w03_running, "w04_second": w04_second, "w05_round_robin": w05_round_robin, "o01_sorted": o01_sorted, "o02_per_group": o02_per_group, "u01_union": u01_union,
    "u02_intersect": u02_intersect, "u03_except": u03_except, "u04_partition": u04_partition, "j01_granularity": j01_granularity, "j02_enriched": j02_enriched, "j05_title_year": j05_title_year, "j10_anti": j10_anti, "j11_semi": j11_semi,
    "j13_parents": j13_parents, "j14_left": j14_left,
}
_FIN = "score IS NOT NULL AND isfinite(score)"
SQL = {
    "q01_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "q03_top_orders": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_orderkey ORDER BY 2 DESC, 1 LIMIT 10",
    "q05_nations": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "a02_distinct": "SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY event_type",
    "a03_argmax": "SELECT user_id, first(event_id ORDER BY value DESC, event_id DESC) AS best_event, round(max(value), 4) AS top, round(avg(value), 6) AS mean FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "a04_population_std": "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(stddev_pop(o_totalprice), 2) AS std FROM orders GROUP BY ALL",
    "a06_pivot": "SELECT query_id, " + ", ".join(f"count(*) FILTER (branch = '{b}') AS {b}" for b in ("bm25", "bm25_pyvi", "dense", "exact")) + " FROM static_candidates GROUP BY query_id",
    "a07_rollup": "SELECT coalesce(p_brand, 'all') AS brand, coalesce(CAST(p_size AS VARCHAR), 'all') AS size, count(*) AS n, grouping_id(p_brand, p_size) AS level FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "a08_approximate": "SELECT true AS close, count(DISTINCT l_partkey) AS n FROM lineitem",
    "w02_margin": f"""WITH o AS (SELECT query_id, branch, doc_id, max(score) AS score FROM static_candidates WHERE {_FIN} GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY query_id, branch ORDER BY score DESC, doc_id))
      SELECT query_id, branch, doc_id, round(coalesce((score - nxt)::DOUBLE, 0), 5) AS margin FROM r WHERE rank = 1""",
    "w03_running": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)",
    "w04_second": f"WITH o AS (SELECT query_id, doc_id, max(score::DOUBLE) AS score FROM static_candidates WHERE {_FIN} GROUP BY ALL) SELECT query_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o) WHERE rank = 2",
    "w05_round_robin": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round FROM events WHERE user_id IS NOT NULL",
    "o01_sorted": "SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier ORDER BY supplier.s_acctbal DESC, s_suppkey LIMIT 20",
    "o02_per_group": "SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3",
    "u01_union": "SELECT source, count(*) AS n, count(DISTINCT article) AS n_articles FROM (SELECT 'chunks' AS source, article FROM chunks UNION ALL SELECT 'macro', article FROM macro_chunks) GROUP BY source",
    "u02_intersect": "SELECT chunk_id FROM macro_chunks INTERSECT SELECT chunk_id FROM chunks",
    "u03_except": f"{P.with_tables('qs', 'rels')} SELECT query_id FROM qs WHERE query_id NOT IN (SELECT query_id FROM rels)",
    "u04_partition": "SELECT id, count(*) AS n FROM (SELECT DISTINCT id, side FROM (SELECT unnest(train_doc_ids) AS id, 0 AS side FROM doc_disjoint_split UNION ALL SELECT unnest(val_doc_ids), 1 FROM doc_disjoint_split) WHERE id IS NOT NULL) GROUP BY id HAVING count(*) > 1",
    "j01_granularity": f"{P.with_tables('cks')} SELECT granularity, count(*) AS n, count(DISTINCT {P.given('document_id')}) AS n_docs FROM cks GROUP BY ALL",
    "j02_enriched": f"{P.with_tables('cks', 'docs')} SELECT chunk_id, {P.given('c.document_id')} AS doc_id, title, legal_number, year FROM cks c LEFT JOIN docs d ON d.doc_id = {P.given('c.document_id')}",
    "j05_title_year": f"{P.with_tables('docs')} SELECT a.doc_id AS doc_id, b.doc_id AS other_id, a.year AS year FROM docs a JOIN docs b ON a.year = b.year AND a.doc_id <> b.doc_id AND contains(lower(b.title), list_last(string_split(lower(a.title), ' về '))) AND length(list_last(string_split(lower(a.title), ' về '))) >= 7",
    "j10_anti": f"{P.with_tables('docs', 'rels')} SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM rels)",
    "j11_semi": f"{P.with_tables('cks', 'rels')}, c AS (SELECT {P.given('document_id')} AS doc_id FROM cks) SELECT doc_id, count(*) AS n FROM c WHERE doc_id IN (SELECT doc_id FROM rels) GROUP BY doc_id",
    "j13_parents": f"{P.with_tables('cks')}, m AS (SELECT chunk_id, {P.given('document_id')} AS d FROM cks WHERE granularity = 'macro') SELECT {P.given('c.document_id')} IS NOT DISTINCT FROM m.d AS same, count(*) AS n FROM cks c LEFT JOIN m ON m.chunk_id = c.parent_chunk_id WHERE c.granularity = 'micro' GROUP BY ALL",
    "j14_left": f"{P.with_tables('cks', 'rels')}, m AS (SELECT {P.given('document_id')} AS doc_id, count(*) AS n FROM cks WHERE granularity = 'macro' GROUP BY ALL) SELECT query_id, r.doc_id AS doc_id, coalesce(n, 0) AS n_chunks FROM rels r LEFT JOIN m ON m.doc_id = r.doc_id",
}
