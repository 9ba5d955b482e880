"""Queries on stored forms: what is written in a format is read again, and small rules on their numbers."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from siltstone.operators import evidence as E
from siltstone.operators import learning as G
from siltstone.operators import metrics as M
from siltstone.operators import pairs as N
from siltstone.operators import ranking as R
from siltstone.operators import rerank as K
from siltstone.operators import splits as S
from siltstone.plans import evaluation as A
from siltstone.plans import evidence as V
from siltstone.plans import sqlparts as P
from siltstone.sources import canonical as C
from siltstone.sources import raw, stores
from siltstone.sources.tables import table
from siltstone.storage import cut, new_path


def _items(s, d) -> list[dict]:
    """The evaluation texts, a table of fixed size, in the shape of raw documents."""
    rows = table(s, d, "eval_items").orderBy("item_id").collect()
    return [{"id": str(r["item_id"]), "name": r["kind"], "link": r["split_name"], "passage": r["text"]} for r in rows]


def _shown(df):
    return df.select("id", "name", "link", F.md5("passage").alias("digest"))


def s01_zip(s, d):
    """Documents from two zip files, read in parallel."""
    items, path = _items(s, d), new_path(s, "zips")
    for part in range(2):
        z = io.BytesIO()
        with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
            for x in items[part::2]:
                f.writestr(f"folder/context_{x['id']}.json", json.dumps(x))
            f.writestr("folder/other.json", "{}")
        stores.write_bytes(s, f"{path}/{part}.zip", z.getvalue())
    return _shown(raw.zip_contexts(s, f"{path}/*.zip"))


def s02_json(s, d):
    path = new_path(s, "contexts")
    for x in _items(s, d):
        stores.write_bytes(s, f"{path}/context_{x['id']}.json", json.dumps(x, indent=1).encode())
    return _shown(raw.json_contexts(s, path))


def s03_question_map(s, d):
    """A map whose values are texts or objects."""
    path = new_path(s, "map") + ".json"
    items = {x["id"]: x["passage"] if int(x["id"]) % 2 else {"question": x["passage"], "answer": [x["name"]]} for x in _items(s, d)}
    stores.write_bytes(s, path, json.dumps(items).encode())
    return raw.question_map(s, path).select("query_id", F.md5("question").alias("digest"), F.array_join("answer", ",").alias("answer"), F.col("place.n").alias("place"))


def s06_column(s, d):
    """One column in batches of a stated number of rows, without the rest of the table."""
    b = raw.column_batches(table(s, d, "chunks"), "text_norm", 500)
    return b.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.sum("n_bytes").alias("n_bytes"))


def _written(s, d):
    path = new_path(s, "answers")
    return path, stores.write_answers(A._answers(s, d), path)


def s14_answers(s, d):
    """The answer file, read again."""
    path, _ = _written(s, d)
    return raw.question_map(s, f"{path}/submission.json").select("query_id", F.array_join("answer", ",").alias("answer"))


def s15_answer_zip(s, d):
    path, manifest = _written(s, d)
    data = stores.read_bytes(s, f"{path}/submission.zip")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        same = z.read("submission.json") == stores.read_bytes(s, f"{path}/submission.json")
    return s.createDataFrame([(manifest["queries"], same, len(stores.zip_errors(data)))], "n_queries long, same boolean, n_errors long")


def s16_encoded_once(s, d):
    """Half of the texts are encoded first; the second call encodes only what the store lacks."""
    path = new_path(s, "encoded")
    texts = C.docs(s, d).select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("text"))
    made = lambda df: df.select("id", F.array(F.length("text").cast("double")).alias("v"))
    stores.encoded_once(texts.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0), path, made)
    return stores.encoded_once(texts, path, made).select("id", F.get("v", F.lit(0)).alias("n"))


def s19_descriptor(s, d):
    path = new_path(s, "winner") + ".json"
    model = G.Ridge(V.LEARNED).fit(V._features(s, d))
    stores.write_descriptor(s, path, "ridge", model.to_json(), weights=R.BRANCH_WEIGHTS)
    x = stores.read_descriptor(s, path)
    again = G.Ridge.from_json(x["payload"])
    same = again.columns == model.columns and all(abs(a - b) < 1e-12 for a, b in zip(again.coefficients, model.coefficients, strict=True))
    return s.createDataFrame([(x["winner"], x["rrf"]["k"], same)], "winner string, k int, same boolean")


def s20_index_states(s, d):
    """The state of a vector index under its own identity, another one, and none."""
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("v"))
    path = new_path(s, "vectors")
    stores.save_vectors(e, path, "given", "0" * 40)
    asked = {"own": (path, "0" * 40), "other": (path, "1" * 40), "none": (path + "-none", "0" * 40)}
    return s.createDataFrame([(k, stores.index_state(s, p, "given", r)[0]) for k, (p, r) in asked.items()], "identity string, state string")


def s21_stored_model(s, d):
    """Both kinds of rankers stored, told apart by their form and ranking as before."""
    f = cut(V._features(s, d), "features")
    out = None
    for kind, model in (("ridge", G.Ridge(V.LEARNED).fit(f)), ("boosted", G.Boosted(V.LEARNED, rounds=3, depth=2).fit(f))):
        path = new_path(s, kind)
        G.save_model(s, model, path)
        got = G.load_model(s, path)
        a = model.rank(f).select("query_id", "doc_id", F.col("final_rank").alias("a"))
        b = got.rank(f).select("query_id", "doc_id", F.col("final_rank").alias("b"))
        one = a.join(b, ["query_id", "doc_id"]).agg(F.count_if(F.col("a") == F.col("b")).alias("n_same")).select(F.lit(kind).alias("kind"), F.lit(type(got).__name__.lower()).alias("loaded"), "n_same")
        out = one if out is None else out.union(one)
    return out


def s22_located(s, d):
    path = new_path(s, "bundle")
    for name in ("a.json", "models/b.json", "b.json"):
        stores.write_bytes(s, f"{path}/{name}", b"{}")
    return s.createDataFrame([(n, stores.located(s, path, n, "models").removeprefix(path)) for n in ("a.json", "b.json")], "name string, path string")


def s23_vectors_from(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("v"))
    return stores.vectors_from(e.select("id", "doc_id"), e.select("id", "v")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def s24_to_df(s, d):
    """One table from a frame, a map, rows and bare ids."""
    given = {"frame": s.createDataFrame([("1", "a", 0)], "query_id string, question string, x int"), "map": {"1": "a"}, "objects": {"1": {"question": "a"}}, "rows": [("1", "a")], "dicts": [{"query_id": "1", "question": "a"}], "ids": ["1"]}
    out = None
    for k, x in given.items():
        one = raw.to_df(s, x, "query_id string, question string").select(F.lit(k).alias("given"), "query_id", "question")
        out = one if out is None else out.union(one)
    return out


def e09_stored_macros(s, d):
    """Evidence that reads the macro store of the candidates' documents only."""
    path, c = new_path(s, "macros"), V._candidates(s, d)
    V._macros(s, d).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    got = E.selected(E.scored_chunks(c, V._questions(s, d), stores.macro_chunks_of(s.read.parquet(path), c)), 3)
    return got.select("query_id", "doc_id", F.array_join(F.transform("chunks", lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


def k07_documents(s, d):
    """Documents reranked by their packs; without a scorer the order stays and nothing is scored."""
    packs = V._packs(s, d)
    c = V._fused(s, d).select("query_id", "doc_id", "rank", "rrf_score")
    one = K.reranked_packs(c, packs, V._questions(s, d), 5, K.shared_words)
    none = K.reranked_packs(c, packs, V._questions(s, d), 5, None)
    shown = lambda df, k: df.select(F.lit(k).alias("scorer"), "query_id", "doc_id", "reranker_score", "rerank_rank")
    return shown(one, "words").union(shown(none, "none"))


def k09_headers(s, d):
    t = C.docs(s, d).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("legal_number", F.lit("")).alias("number"))
    return t.select("doc_id", E.labelled_header("title", "number").alias("header"))


def o03_best(s, d):
    """The first three candidates of every query by score, without ordering the rest."""
    return R.best(R.branch_ranks(table(s, d, "static_candidates"), 50).select("query_id", "branch", "doc_id", "score"), ["query_id"], [F.desc("score"), F.asc("branch"), F.asc("doc_id")], 3).select("query_id", "branch", "doc_id", "rank")


def s_p05_stored_folds(s, d):
    """Folds stored as a list, under either name of their ids, and read again."""
    path = new_path(s, "folds")
    folds = S.bucket_folds(C.questions(s, d).select("query_id"))
    by = folds.groupBy("fold").agg(F.sort_array(F.collect_list("query_id")).alias("ids")).orderBy("fold").collect()  # the stored form is one file
    every = sorted(q for r in by for q in r["ids"])
    one = [{"fold": r["fold"], "train": [q for q in every if q not in set(r["ids"])], "val": r["ids"]} for r in by]
    other = [{"fold": x["fold"], "train_query_ids": x["train"], "val_query_ids": x["val"]} for x in one]
    for name, x in (("one", one), ("other", other)):
        stores.write_bytes(s, f"{path}/{name}.json", json.dumps(x).encode())
    return S.folds_from_json(s, f"{path}/one.json").intersect(S.folds_from_json(s, f"{path}/other.json"))


def s_p13_pairs(s, d):
    """Pairs stored in batches of queries; one batch is lost and made again, the others are kept."""
    pairs, path = cut(A._pairs(s, d), "all-pairs"), new_path(s, "materialized")
    make = lambda q: pairs.join(q, "query_id", "left_semi")
    q = C.questions(s, d).select("query_id")
    N.materialized(make, q, path, 3)
    fs, p = stores._fs(s, f"{path}/batch=1/_SUCCESS")
    fs.delete(p, False)
    return N.materialized(make, q, path, 3).select("query_id", "doc_id", F.col("label").cast("int").alias("label"), "retrieval_rank")


def s_p13_candidates(s, d):
    """Validation candidates of every question."""
    got = N.validation_candidates(V._fused(s, d), C.relevant(s, d), V._questions(s, d), S.bucket_folds(C.questions(s, d).select("query_id")))
    return got.select("query_id", "doc_id", "gold_doc_ids", F.round("rrf_score", 8).alias("rrf_score"), "fold", F.md5("query_text").alias("digest"))


def s_p15_blocked(s, d):
    return N.sampled_order(A._pairs(s, d), epoch=1, blocked=True).select("query_id", "doc_id", "side", "round", "block", "query_place")


def s_p15_groups(s, d):
    return N.group_order(N.listwise_groups(A._pairs(s, d)), epoch=2).select("query_id", "positive", "round", "query_place")


def s_p17_steps(s, d):
    eligible = N.coverage(A._pairs(s, d), C.questions(s, d)).first()["eligible"]
    return s.createDataFrame([(eligible, N.required_steps(eligible, 2, 8))], "eligible long, steps long")


def s_p21_schema(s, d):
    rows = [(k, N.pair_schema(c)[0]) for k, c in (("triples", ["query", "pos_text", "neg_text"]), ("pairs", ["question", "label", "evidence_text", "x"]), ("both", ["query_text", "positive", "negative", "label", "text"]))]
    return s.createDataFrame(rows, "given string, kind string")


def v07_same_scores(s, d):
    """Fused scores against themselves moved a little and, for one document in a hundred, a lot."""
    f = V._fused(s, d).select("query_id", "doc_id", "rrf_score")
    far = F.conv(F.substring(F.md5(F.concat("query_id", "doc_id")), 1, 2), 16, 10).cast("int") < 3
    moved = f.withColumn("rrf_score", F.when(far, F.col("rrf_score") + 1).otherwise(F.col("rrf_score") + 0.001))
    return M.same_scores(f, moved, ["query_id", "doc_id"], "rrf_score").select("query_id", "doc_id")


def v09_promoted(s, d):
    base = {"recall@5": 0.7, "precision@5": 0.2, "candidate_recall@150": 0.95, "disjoint_recall@5": 0.6}
    cases = {"better": {"recall@5": 0.71}, "worse": {"recall@5": 0.69}, "precision decides": {"precision@5": 0.21}, "same": {}, "candidates lost": {"recall@5": 0.8, "candidate_recall@150": 0.9}, "disjoint lost": {"recall@5": 0.8, "disjoint_recall@5": 0.5}}
    return s.createDataFrame([(k, M.promoted(base | x, base)[0]) for k, x in cases.items()], "given string, promoted boolean")


def v13_same_order(s, d):
    """Answers of five against the same cut to four: queries with five documents differ."""
    a = A._answers(s, d)
    return M.same_order(a, a.select("query_id", F.slice("answer", 1, 4).alias("answer")))


def v16_budgets(s, d):
    """Parameter budget (V16) and projected seconds (V17)."""
    n, ok = G.parameter_budget({"encoder": 134_998_272, "reranker": 567_755_777})
    return s.createDataFrame([(n, ok, G.parameter_budget({"x": 4_000_000_000})[1], G.projected_seconds(30.0, 10, 100, 10.0))], "total long, fits boolean, large_fits boolean, seconds double")


def v18_sealed(s, d):
    """A bundle is sealed, verified, then one file is changed, one removed and one added."""
    path = new_path(s, "bundle")
    for k in range(4):
        stores.write_bytes(s, f"{path}/files/{k}.txt", str(k).encode())
    raw.seal(s, f"{path}/files", f"{path}/seal")
    sound = raw.broken_seal(s, f"{path}/files", f"{path}/seal").select(F.lit("sealed").alias("given"), "path", "change")
    sound = cut(sound, "sound")
    stores.write_bytes(s, f"{path}/files/1.txt", b"x")
    stores.write_bytes(s, f"{path}/files/9.txt", b"9")
    fs, p = stores._fs(s, f"{path}/files/2.txt")
    fs.delete(p, False)
    return sound.union(raw.broken_seal(s, f"{path}/files", f"{path}/seal").select(F.lit("touched"), "path", "change"))


def v21_cutoffs(s, d):
    return s.createDataFrame([(i, c) for i, c in enumerate(M.cutoffs([50, 20, 50, 5]))], "place long, cutoff long")


def v14_acceptance(s, d):
    """Coverage and measures recomputed from stored answers, with the verdict that they support."""
    path, _ = _written(s, d)
    stored = raw.question_map(s, f"{path}/submission.json").select("query_id", "answer")
    return M.acceptance(stored, C.questions(s, d), C.docs(s, d), C.relevant(s, d), {"recall": 0.0, "precision": 0.0})


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith(("s0", "s1", "s2", "e09", "k0", "o03", "s_p", "v0", "v1", "v2")) and callable(f)}


def _rows(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({names})"


_CONTEXTS = "SELECT CAST(item_id AS VARCHAR) AS id, kind AS name, split_name AS link, md5(text) AS digest FROM eval_items"
_ANSWER = f"{A._top(5)} SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) AS answer FROM top GROUP BY query_id"
SQL = {
    "s01_zip": _CONTEXTS,
    "s02_json": _CONTEXTS,
    "s03_question_map": "SELECT CAST(item_id AS VARCHAR) AS query_id, md5(text) AS digest, CASE WHEN item_id % 2 = 0 THEN kind END AS answer, item_id AS place FROM eval_items",
    "s06_column": "SELECT count(*) AS n_rows, count(text_norm) AS n_values, sum(octet_length(encode(text_norm))) AS n_bytes FROM chunks",
    "s14_answers": _ANSWER,
    "s15_answer_zip": f"{A._top(5)} SELECT count(DISTINCT query_id) AS n_queries, true AS same, 0::BIGINT AS n_errors FROM top",
    "s16_encoded_once": f"{P.with_tables('docs')} SELECT doc_id AS id, length(coalesce(title, ''))::DOUBLE AS n FROM docs",
    "s19_descriptor": _rows("winner, k, same", "'ridge', 60, true"),
    "s20_index_states": _rows("identity, state", "'own', 'PASS'", "'other', 'FAIL'", "'none', 'BLOCKED'"),
    "s21_stored_model": f"{V._FEAT} SELECT kind, kind AS loaded, (SELECT count(*) FROM feat) AS n_same FROM (VALUES ('ridge'), ('boosted')) AS t(kind)",
    "s22_located": _rows("name, path", "'a.json', '/a.json'", "'b.json', '/models/b.json'"),
    "s23_vectors_from": "SELECT CAST(label AS VARCHAR) AS doc_id, count(*) AS n FROM embeddings GROUP BY label",
    "s24_to_df": "SELECT g AS given, '1' AS query_id, CASE WHEN g <> 'ids' THEN 'a' END AS question FROM (SELECT unnest(['frame', 'map', 'objects', 'rows', 'dicts', 'ids']) AS g)",
    "e09_stored_macros": V.SQL["e04_selected"],
    "k07_documents": f"""{V._PACKS}, ps AS (SELECT t.query_id, t.doc_id, rank, rank <= 5 AS head, {V._words('question_raw', 'pack')} AS w, pack FROM top t LEFT JOIN pk USING (query_id, doc_id) LEFT JOIN qs ON qs.query_id = t.query_id)
      SELECT 'words' AS scorer, query_id, doc_id, sc AS reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, CASE WHEN head THEN -sc END, CASE WHEN NOT head THEN rank END, doc_id) AS rerank_rank FROM (SELECT *, CASE WHEN NOT head THEN -999.0::DOUBLE WHEN pack IS NULL THEN 0.0 ELSE w END AS sc FROM ps)
      UNION ALL SELECT 'none', query_id, doc_id, -999.0, rank FROM top""",
    "k09_headers": f"{P.with_tables('docs')} SELECT doc_id, '[VĂN BẢN]: ' || coalesce(title, '') || CASE WHEN coalesce(legal_number, '') <> '' THEN ' (Số: ' || legal_number || ')' ELSE '' END AS header FROM docs",
    "o03_best": f"{A.ranks_sql(50)} SELECT query_id, branch, doc_id, rank FROM (SELECT query_id, branch, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, branch, doc_id) AS rank FROM ranks) WHERE rank <= 3",
    "s_p05_stored_folds": f"{P.with_tables('qs')}, f AS (SELECT query_id, {V._FOLD} AS fold FROM qs), n AS (SELECT DISTINCT fold FROM f) SELECT n.fold AS fold, CASE WHEN n.fold = f.fold THEN 'val' ELSE 'train' END AS side, query_id FROM n, f",
    "s_p13_pairs": f"{A._PAIRS} SELECT query_id, doc_id, label::INT AS label, retrieval_rank FROM pp",
    "s_p13_candidates": f"""{V._CAND}, gd AS (SELECT query_id, '[' || string_agg('"' || doc_id || '"', ',' ORDER BY doc_id) || ']' AS g FROM rels GROUP BY query_id)
      SELECT t.query_id AS query_id, doc_id, coalesce(g, '[]') AS gold_doc_ids, round(rrf_score, 8) AS rrf_score, {V._FOLD.replace('query_id', 't.query_id')} AS fold, md5(question_raw) AS digest FROM top t JOIN qs ON qs.query_id = t.query_id LEFT JOIN gd ON gd.query_id = t.query_id""",
    "s_p15_blocked": f"""{A._PAIRS}, sd AS (SELECT *, CASE WHEN label > 0.5 THEN 0 ELSE 1 END AS side FROM pp), b AS (SELECT query_id, CASE WHEN count(DISTINCT side) < 2 THEN '1' ELSE '0' END AS one FROM sd GROUP BY ALL),
      od AS (SELECT query_id, doc_id, side, one, row_number() OVER (PARTITION BY query_id, side ORDER BY retrieval_rank, doc_id) AS round FROM sd JOIN b USING (query_id))
      SELECT query_id, doc_id, side, round, CASE WHEN round > 1 THEN 0 WHEN one = '0' THEN side ELSE 2 END AS block, one || md5('43:' || query_id) AS query_place FROM od""",
    "s_p15_groups": f"""{A._PAIRS}, ps AS (SELECT DISTINCT query_id, doc_id AS positive FROM pp WHERE label > 0.5 AND query_id IN (SELECT query_id FROM pp WHERE label <= 0.5))
      SELECT query_id, positive, row_number() OVER (PARTITION BY query_id ORDER BY positive) AS round, md5('44:' || query_id) AS query_place FROM ps""",
    "s_p17_steps": f"{A._PAIRS}, h AS (SELECT query_id FROM pp GROUP BY query_id HAVING count(DISTINCT label) = 2) SELECT count(*) AS eligible, ceil(2 * count(*) / 16.0)::BIGINT AS steps FROM h",
    "s_p21_schema": _rows("given, kind", "'triples', 'pairwise'", "'pairs', 'pointwise'", "'both', 'pairwise'"),
    "v07_same_scores": f"{V._CAND} SELECT query_id, doc_id FROM top WHERE CAST(('0x' || left(md5(query_id || doc_id), 2)) AS INT) < 3",
    "v09_promoted": _rows("given, promoted", "'better', true", "'worse', false", "'precision decides', true", "'same', false", "'candidates lost', false", "'disjoint lost', false"),
    "v13_same_order": f"{A._top(5)} SELECT query_id FROM top GROUP BY query_id HAVING count(*) = 5",
    "v16_budgets": _rows("total, fits, large_fits, seconds", "702754049, true, false, 210.0"),
    "v18_sealed": _rows("given, path, change", "'touched', '1.txt', 'changed'", "'touched', '2.txt', 'missing'", "'touched', '9.txt', 'new'"),
    "v21_cutoffs": _rows("place, cutoff", "0, 50", "1, 20", "2, 5"),
    "v14_acceptance": f"""{A._PQ}, e AS (SELECT count(*) AS n_expected, count(t.query_id) AS n_answered FROM qs LEFT JOIN (SELECT DISTINCT query_id FROM top) t USING (query_id)),
      w AS (SELECT count(*) AS n_errors FROM (SELECT DISTINCT query_id FROM top WHERE doc_id NOT IN (SELECT doc_id FROM docs) UNION ALL SELECT query_id FROM qs WHERE query_id NOT IN (SELECT query_id FROM top) UNION ALL SELECT DISTINCT query_id FROM top WHERE query_id NOT IN (SELECT query_id FROM qs)))
      SELECT n_expected, n_answered, n_errors, (SELECT round(avg(recall), 6) FROM m) AS recall, (SELECT round(avg(precision), 6) FROM m) AS precision, CASE WHEN n_errors = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM e, w""",
}
