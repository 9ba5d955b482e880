"""Queries on scans, caches and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import lexical as L
from siltstone.plans import sqlparts as P
from siltstone.plans.retrieval import TOP_K, _micro, _queries
from siltstone.plans.retrieval import SQL as RETRIEVAL
from siltstone.sources import canonical as C
from siltstone.sources import raw, stores
from siltstone.sources.tables import table
from siltstone.storage import new_path


def s04_existing(s, d):
    return raw.existing(table(s, d, "legal_docs"), ["doc_id", "title", "no_such_column", "year"]).distinct()


def s05_footers(s, d):
    m = raw.footer_metadata(s, f"{d}/chunks.parquet")
    return m.agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))


def _cache(s, d):
    path = new_path(s, "cache")
    stores.write_candidates(table(s, d, "static_candidates"), path)
    return path


def s07_cache(s, d):
    c = s.read.schema(stores.CANDIDATES).parquet(_cache(s, d))
    return c.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"))


def s08_point_read(s, d):
    return stores.candidates_of(s, _cache(s, d), "q100", "exact").groupBy("query_id", "branch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def s09_cached_queries(s, d):
    return stores.cached_queries(s, _cache(s, d))


def s10_macros(s, d):
    return stores.macro_chunks_of(C.chunks(s, d), C.relevant(s, d)).select("doc_id", "chunk_id", "article")


def s11_vectors(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("v"))
    path, rev = new_path(s, "vectors"), "0" * 40
    stores.save_vectors(e, path, "given", rev)
    return stores.load_vectors(s, path, "given", rev).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dimension"))


def s12_stored_index(s, d):
    """The lexical search over an index that was written and read again."""
    micro, path = _micro(s, d), new_path(s, "index")
    stores.save_index(L.bagged(micro), path)
    cut = L.top(stores.load_index(s, path), L.query_terms(_queries(s, d), "question"), TOP_K)
    return cut.select("query_id", "chunk_id", F.round("raw_score", 5).alias("raw_score"), "chunk_rank")


def s17_inventory(s, d):
    """Files of a written table with size and digest; sizes agree with the footers'."""
    path = new_path(s, "copy")
    table(s, d, "eval_items").coalesce(1).write.parquet(path)
    i = raw.inventory(s, path, "*.parquet")
    return i.join(raw.footer_metadata(s, path).select(F.col("n_bytes").alias("n_bytes"), "n_rows"), "n_bytes").agg(F.count("sha256").alias("n_files"), F.sum("n_rows").alias("n_rows"))


def s18_fingerprint(s, d):
    path = new_path(s, "copy")
    table(s, d, "eval_items").write.parquet(path)
    a, b = raw.inventory(s, path), raw.inventory(s, path)
    return s.createDataFrame([(raw.fingerprint(a) == raw.fingerprint(b), raw.inventory_changes(a, b).count())], "same boolean, n_changes long")


QUERIES = {
    "s04_existing": s04_existing, "s05_footers": s05_footers, "s07_cache": s07_cache, "s08_point_read": s08_point_read, "s09_cached_queries": s09_cached_queries, "s10_macros": s10_macros, "s11_vectors": s11_vectors,
    "s12_stored_index": s12_stored_index, "s17_inventory": s17_inventory, "s18_fingerprint": s18_fingerprint,
}
SQL = {
    "s04_existing": "SELECT DISTINCT doc_id, title, year FROM legal_docs",
    "s05_footers": "SELECT count(*) AS n_rows, 14 AS n_columns FROM chunks",
    "s07_cache": "SELECT branch, count(*) AS n, count(DISTINCT query_id) AS n_queries FROM static_candidates GROUP BY branch",
    "s08_point_read": "SELECT query_id, branch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM static_candidates WHERE query_id = 'q100' AND branch = 'exact' GROUP BY ALL",
    "s09_cached_queries": "SELECT DISTINCT query_id FROM static_candidates",
    "s10_macros": f"{P.with_tables('cks', 'rels')} SELECT {P.given('document_id')} AS doc_id, chunk_id, article FROM cks WHERE granularity = 'macro' AND {P.given('document_id')} IN (SELECT doc_id FROM rels)",
    "s11_vectors": "SELECT CAST(label AS VARCHAR) AS doc_id, count(*) AS n, max(len(embedding)) AS dimension FROM embeddings GROUP BY label",
    "s17_inventory": "SELECT 1::BIGINT AS n_files, count(*) AS n_rows FROM eval_items",
    "s18_fingerprint": "SELECT true AS same, 0::BIGINT AS n_changes",
    "s12_stored_index": RETRIEVAL["r03_cut_off"],
}
