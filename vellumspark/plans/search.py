"""Queries of chunking, lexical, dense and hybrid search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.stopwords import SEARCH_STOPWORDS
from vellumspark.functions.vectors import cosine, is_usable
from vellumspark.operators import blocks as postings
from vellumspark.operators import bm25, chunking, dense, hybrid, store
from vellumspark.operators.engine import SCHEMA, HybridSearchEngine
from vellumspark.operators.filters import SearchFilter, compile_where
from vellumspark.plans import common as c
from vellumspark.plans.common import blocks, chunks, embedded, papers, search_queries, sections
from vellumspark.streaming.ingest import upsert_stream
from vellumspark.tables import current_rows, load, own_folder

USABLE_DIM = 64


_INDEXES: dict[tuple[str, str], bm25.StoredBM25] = {}


def _index(spark: SparkSession, d: str) -> bm25.BM25Index:
    """The lexical index of a folder's chunks, built by the first query of a session that needs it and read by all."""
    name = spark.sparkContext.applicationId, d
    if name not in _INDEXES:
        stored = bm25.StoredBM25(spark, own_folder(spark))
        stored.fit(chunks(spark, d, "embed_text"))
        _INDEXES[name] = stored
    return _INDEXES[name].index()


_BLOCKS: dict[tuple[str, str], DataFrame] = {}
# All columns in the order of the SQL, which decides between rows of a chunk that are equally late.
_COLUMNS = "content_text embed_text token_count char_count paper_id paper_title section_title section_id page_numbers source_block_ids chunk_type is_reference".split()


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Postings of a folder's chunks for tables of queries, built by the first query of a session that needs them."""
    name = spark.sparkContext.applicationId, d
    if name not in _BLOCKS:
        _BLOCKS[name] = postings.build(chunks(spark, d, *_COLUMNS))
    return _BLOCKS[name]


def _usable(spark: SparkSession, d: str, *payload: str) -> DataFrame:
    return embedded(spark, d, "embedding", *payload).where(is_usable(F.col("embedding"), USABLE_DIM))


def q_section_islands(spark: SparkSession, d: str) -> DataFrame:
    runs = chunking.section_runs(blocks(spark, d), sections(spark, d))
    return runs.groupBy("doc_id", "run", "section_title", "section_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("ordinal").alias("first_ordinal"))


def _made(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(blocks(spark, d), sections(spark, d), papers(spark, d), with_parent=False)


def q_chunk_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d).select("chunk_id", "first_sentence", "end_sentence", "token_count", "char_count")


def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda a: F.array_join(F.col(a).cast("array<string>"), ",").alias(a)
    return _made(spark, d).select("chunk_id", "paper_id", "section_title", "section_id", "content_text", "embed_text", listed("page_numbers"), listed("source_block_ids"), "chunk_type", "is_reference")


def q_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.chunk_statistics(chunks(spark, d, "paper_id", "token_count", "page_numbers"), ["paper_id"])
    return s.withColumn("mean_tokens", F.round("mean_tokens", 6)).withColumn("std_tokens", F.round("std_tokens", 6))


def q_bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).corpus.select("n_chunks", F.round("avg_len", 9).alias("avg_len"))


def q_bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).idf().select("term", "df", F.round("idf", 9).alias("idf"))


def q_bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """One query over the whole corpus, top 25."""
    rows = chunks(spark, d, "embed_text", "paper_id", "section_title", "page_numbers")
    return bm25.search(_index(spark, d), rows, "How does the sparse encoder affect the BLEU of a dense decoder?")


def q_bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """The table of queries, each over the whole corpus."""
    return postings.best_hits(_blocks(spark, d), search_queries(spark, d))


def q_bm25_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their own filters: some page of the chunk reaches each bound."""
    filters = F.nullif("filter_paper_id", F.lit("")), F.col("min_page"), F.col("max_page")
    return postings.best_hits(_blocks(spark, d), search_queries(spark, d), filters=filters)


def q_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring vectors by number."""
    v = _usable(spark, d).select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def _one_query(spark: SparkSession, d: str) -> DataFrame:
    rows = _usable(spark, d)
    return rows.agg(F.min_by("embedding", "vec_id").alias("query_vector"))


def q_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    top = dense.nearest_to_one(_usable(spark, d), _one_query(spark, d), 10, id_="vec_id")
    return top.select("vec_id", "score", "distance", "rank")


def q_dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = SearchFilter(min_page=2, max_page=4).on_page() & compile_where({"$and": [{"paper_id": {"$ne": "2119_99999"}}, {"page_number": {"$gte": 1}}]})
    top = dense.nearest_to_one(_usable(spark, d, "paper_id", "page_number", "section_title"), _one_query(spark, d), 10, where, "vec_id")
    return top.select("vec_id", "score", "rank")


def q_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    query = [float(x) for x in range(-32, 32)]
    return dense.by_dot_product(_usable(spark, d), query, 10, "vec_id").select("vec_id", F.round("score", 4).alias("score"))


def q_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The most similar of the vectors with an odd number for each whose number is divisible by 50."""
    rows = _usable(spark, d)
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return dense.best_sentence(rows.where("vec_id % 2 = 1").select("vec_id", F.col("embedding").alias("vector")), asked, "vec_id")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    hits = current_rows(load(spark, d, "hybrid_results"), ["query_id", "chunk_id"], "retrieved_at", ["dense_rank", "dense_score", "sparse_rank", "sparse_score"])
    of = lambda side: hits.where(F.col(f"{side}_rank").isNotNull()).select("query_id", "chunk_id", F.col(f"{side}_rank").alias("rank"), F.col(f"{side}_score").alias("score"))
    return hybrid.fuse(of("dense"), of("sparse"))


def q_rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "rrf_score", "position")


def q_hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best fused hits of each query with their chunks, reranked by overlap; the 5 best."""
    pool = hybrid.assemble(_fused(spark, d).where("position <= 20"), chunks(spark, d, "content_text"))
    asked = pool.join(search_queries(spark, d).select("query_id", "query_text"), "query_id")
    return hybrid.rerank(asked, 5).select("query_id", "chunk_id", "cross_score", "final_score", "rank")


def letter_embedder(letters: str = "abcdefghijklmnop"):
    """Counts of letters: an embedder that SQL can express."""

    def embed(texts):
        return np.array([[t.count(c) for c in letters] for t in texts], dtype=np.float32).reshape(len(texts), len(letters))

    return embed


_ENGINES: dict[tuple[str, str], HybridSearchEngine] = {}


def _engine(spark: SparkSession, d: str) -> HybridSearchEngine:
    name = spark.sparkContext.applicationId, d
    if name not in _ENGINES:
        kept = store.Collection(spark, f"{own_folder(spark)}/chunks", SCHEMA, ["chunk_id"])
        engine = HybridSearchEngine(kept, letter_embedder, hybrid.overlap_score)
        engine.index(chunks(spark, d, "content_text", "embed_text", "paper_id", "paper_title", "section_title", "section_id", "page_numbers", "is_reference", "indexed_at"))
        _ENGINES[name] = engine
    return _ENGINES[name]


def q_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The engine end to end for the queries whose number is divisible by 50: vectors and BM25, fused, reranked."""
    asked = search_queries(spark, d).where("query_id % 50 = 0").select("query_id", "query_text")
    return _engine(spark, d).search(asked).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "rrf_score", "cross_score", "rank")


def q_hybrid_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same without reranking, for the pages from 2 to 4."""
    asked = search_queries(spark, d).where("query_id % 50 = 0").select("query_id", "query_text")
    return _engine(spark, d).search(asked, search_filter=SearchFilter(min_page=2, max_page=4), rerank=False).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "rrf_score", "rank")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return embedded(spark, d, "paper_id", "page_number", "section_title", "text", "metadata")


def q_upsert_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Odd rows, then all rows, then all rows again."""
    rows = embedded(spark, d, "paper_id", "page_number")
    odd = rows.where("vec_id % 2 = 1").withColumn("page_number", F.lit(-1))
    return store.upsert(store.upsert(odd, rows, ["vec_id"]), rows, ["vec_id"])


def q_delete_paper(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d, "paper_id")
    left = store.delete_paper(rows, "2119_99999")
    return left.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


def q_deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    return store.deleted_rows(embedded(spark, d, "paper_id"), chunks(spark, d, "paper_id"), "2119_99999")


def q_indexed_papers(spark: SparkSession, d: str) -> DataFrame:
    rows = store.prepare_blocks(_stored(spark, d))
    return store.indexed_papers(rows)


def q_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.collection_stats(embedded(spark, d, "paper_id"))


def q_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The chunks as a stream of files into a collection, to its end."""
    folder = own_folder(spark)
    schema = "chunk_id string, paper_id string, token_count int, indexed_at timestamp_ntz"
    kept = store.Collection(spark, f"{folder}/table", schema, ["chunk_id"])
    stream = spark.readStream.schema(schema).parquet(f"{d}/chunks.parquet*")
    upsert_stream(stream, kept, "indexed_at", f"{folder}/state", once=True).awaitTermination()
    return kept.read().select("chunk_id", "paper_id", "token_count")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_RUNS = f"""WITH RECURSIVE {c.SQL_SECTIONS}, {c.SQL_BLOCKS}, {c.SQL_PAPERS},
b AS (SELECT blk.doc_id, coalesce(nullif(sec.title, ''), 'Main Content') AS section_title, blk.section_id, ordinal, block_id, page_number, {c.sql_clean('text')} AS text FROM blk LEFT JOIN sec ON sec.doc_id = blk.doc_id AND sec.section_id = blk.section_id),
b1 AS (SELECT *, CASE WHEN lag(section_title) OVER r IS DISTINCT FROM section_title OR row_number() OVER r = 1 THEN 1 ELSE 0 END AS new FROM b WHERE {c.sql_words('text')} >= 3 WINDOW r AS (PARTITION BY doc_id ORDER BY ordinal, block_id)),
runs0 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ordinal, block_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b1),
runs AS (SELECT * EXCLUDE (section_id), first_value(section_id) OVER (PARTITION BY doc_id, run ORDER BY ordinal, block_id) AS section_id FROM runs0)"""
_CHUNKS = (
    _RUNS
    + f""", us AS (SELECT doc_id, run, section_title, section_id, ordinal, block_id, page_number, generate_subscripts(s, 1) AS i, unnest(s) AS sentence FROM (SELECT *, {c.sql_segment('text')} AS s FROM runs)),
ua AS (SELECT doc_id, run, any_value(section_title) AS section_title, any_value(section_id) AS section_id, list(sentence ORDER BY ordinal, block_id, i) AS st, list({c.sql_estimate('sentence')} ORDER BY ordinal, block_id, i) AS tk, list(page_number ORDER BY ordinal, block_id, i) AS pg, list(block_id ORDER BY ordinal, block_id, i) AS bl FROM us GROUP BY doc_id, run),
up AS (SELECT *, len(tk)::INT AS n, list_prepend(0, list_transform(tk, lambda x, i: list_sum(tk[1:i]))) AS p FROM ua),
ch AS (
  SELECT doc_id, run, n, p, tk, 1 AS k, 0 AS a, CASE WHEN tk[1] >= 300 THEN 1 ELSE len(list_filter(p[2:], lambda x: x <= 300)) END::INT AS e FROM up
  UNION ALL
  SELECT doc_id, run, n, p, tk, k + 1, s, CASE WHEN tk[s + 1] >= 300 THEN s + 1 ELSE s + len(list_filter(p[s + 2:], lambda x: x - p[s + 1] <= 300)) END::INT FROM (
    SELECT *, CASE WHEN back > 0 AND back < e - a THEN e - back ELSE e END::INT AS s FROM (SELECT *, len(list_filter(p[1:e], lambda x: p[e + 1] - x <= 50)) AS back FROM ch WHERE e < n))
  WHERE p[n + 1] - p[s + 1] >= 30),
last AS (SELECT doc_id, run, max(k) AS k FROM ch GROUP BY ALL),
cut AS (SELECT ch.doc_id, ch.run, ch.k, a, e, n, CASE WHEN ch.k = last.k AND e < n THEN (CASE WHEN back > 0 AND back < e - a THEN e - back ELSE e END) ELSE n END::INT AS t
  FROM (SELECT *, len(list_filter(p[1:e], lambda x: p[e + 1] - x <= 50)) AS back FROM ch) ch JOIN last ON last.doc_id = ch.doc_id AND last.run = ch.run),
own AS (SELECT cut.*, u.section_title, u.section_id, list_concat(st[a + 1:e], st[t + 1:cut.n]) AS s, list_concat(pg[a + 1:e], pg[t + 1:cut.n]) AS pg, list_concat(bl[a + 1:e], bl[t + 1:cut.n]) AS bl FROM cut JOIN up u ON u.doc_id = cut.doc_id AND u.run = cut.run),
made AS (SELECT coalesce(paper_id, 'paper') || '_s' || run || '_c' || k AS chunk_id, paper_id, coalesce(pap.title, 'Untitled Paper') AS paper_title, section_title, section_id, array_to_string(s, ' ') AS content_text, list_sort(list_distinct(own.pg)) AS pages, list_sort(list_distinct(own.bl)) AS bls, a, e FROM own LEFT JOIN pap ON pap.doc_id = own.doc_id)"""
)
_BM = f"""WITH {c.SQL_CHUNKS}, {c.SQL_QUERIES},
tok AS (SELECT chunk_id, {c.sql_terms('embed_text')} AS t FROM chk),
corpus AS (SELECT count(*) AS n_chunks, coalesce(avg(len(t)), 0) AS avg_len FROM tok),
post AS (SELECT term, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n_chunks) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, corpus GROUP BY term)"""


def _scores(queries: str) -> str:
    return f""", qt0 AS (SELECT query_id, {c.sql_terms('query_text')} AS r FROM {queries}),
qt1 AS (SELECT query_id, r, list_filter(r, lambda t: t NOT IN {c.sql_list(SEARCH_STOPWORDS)}) AS k FROM qt0),
qt AS (SELECT query_id, unnest(CASE WHEN len(r) > 2 AND len(k) > 0 THEN k ELSE r END) AS term FROM qt1),
sc AS (SELECT query_id, chunk_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(1, avg_len)))) AS raw FROM qt JOIN idf ON idf.term = qt.term JOIN post ON post.term = qt.term, corpus GROUP BY query_id, chunk_id)"""


_RANKED = "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(raw, 4) AS score FROM {0} WHERE raw > 0)) WHERE rank <= 25"
_GOOD = "len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_VECS = f"WITH {c.SQL_EMBEDDED}, good AS (SELECT *, embedding::DOUBLE[64] AS v FROM emb WHERE {_GOOD}), q AS (SELECT v AS qv FROM good ORDER BY vec_id LIMIT 1)"
_RRF = """WITH cur AS (SELECT * FROM (SELECT query_id, chunk_id, dense_rank, sparse_rank, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY retrieved_at DESC NULLS LAST, dense_rank NULLS LAST, dense_score NULLS LAST, sparse_rank NULLS LAST, sparse_score NULLS LAST) AS rn FROM hybrid_results) WHERE rn = 1 AND (dense_rank IS NOT NULL OR sparse_rank IS NOT NULL)),
f AS (SELECT *, coalesce(1::DOUBLE / (60 + dense_rank), 0) + coalesce(1::DOUBLE / (60 + sparse_rank), 0) AS rrf FROM cur),
fused AS (SELECT query_id, chunk_id, dense_rank, sparse_rank, round(rrf, 6) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, least(coalesce(dense_rank, 26), coalesce(sparse_rank, 26)), chunk_id) AS position FROM f)"""
_LETTERS = ", ".join(f"length(t) - length(replace(t, '{x}', ''))" for x in "abcdefghijklmnop")


def _engine_sql(condition_dense: str, condition_sparse: str, rerank: bool) -> str:
    """Dense and lexical ranks of the engine's queries, fused; then the order of the reranker or of the fusion."""
    sql = (
        _BM
        + ", ask AS (SELECT query_id, query_text FROM qry WHERE query_id % 50 = 0 AND trim(query_text) <> '')"
        + _scores("ask")
        + f", vec AS (SELECT chunk_id, page_numbers, content_text, [{_LETTERS}]::DOUBLE[] AS v FROM (SELECT *, {c.sql_clean("coalesce(embed_text, '')")} AS t FROM chk)), qv AS (SELECT query_id, [{_LETTERS}]::DOUBLE[] AS q FROM (SELECT query_id, {c.sql_clean('query_text')} AS t FROM ask)),"
        + f" dn0 AS (SELECT query_id, chunk_id, floor(CASE WHEN list_sum(v) = 0 OR list_sum(q) = 0 THEN 0 ELSE list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) END * 10000 + 0.5) AS s FROM vec, qv WHERE {condition_dense}),"
        + " dn AS (SELECT query_id, chunk_id, dense_rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS dense_rank FROM dn0) WHERE dense_rank <= 25),"
        + f" sp AS (SELECT query_id, chunk_id, sparse_rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, chunk_id) AS sparse_rank FROM sc WHERE raw > 0 AND chunk_id IN (SELECT chunk_id FROM chk WHERE {condition_sparse})) WHERE sparse_rank <= 25),"
        + " fu AS (SELECT query_id, chunk_id, dense_rank, sparse_rank, coalesce(1::DOUBLE / (60 + dense_rank), 0) + coalesce(1::DOUBLE / (60 + sparse_rank), 0) AS rrf FROM dn FULL JOIN sp USING (query_id, chunk_id)),"
        + " po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, least(coalesce(dense_rank, 26), coalesce(sparse_rank, 26)), chunk_id) AS position FROM fu)"
    )
    if not rerank:
        return sql + " SELECT query_id, chunk_id, dense_rank, sparse_rank, round(rrf, 6) AS rrf_score, position AS rank FROM po WHERE position <= 5"
    return (
        sql
        + f", cs AS (SELECT po.*, coalesce(len(list_intersect({c.sql_tokens('lower(query_text)')}, {c.sql_tokens('lower(content_text)')})), 0)::DOUBLE AS cross_score FROM po JOIN ask USING (query_id) JOIN vec USING (chunk_id) WHERE position <= 20),"
        + " ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, round(rrf, 6) DESC, chunk_id) AS rank FROM cs) SELECT query_id, chunk_id, dense_rank, sparse_rank, round(rrf, 6) AS rrf_score, cross_score, rank FROM ra WHERE rank <= 5"
    )


ORACLES = {
    "hybrid_search": _engine_sql("true", "true", True),
    "hybrid_search_filtered": _engine_sql("coalesce(page_numbers[1], 1) BETWEEN 2 AND 4", "list_max(page_numbers) >= 2 AND list_min(page_numbers) <= 4", False),
    "section_islands": _RUNS + " SELECT doc_id, run, section_title, section_id, count(*) AS n_blocks, min(ordinal) AS first_ordinal FROM runs GROUP BY ALL",
    "chunk_bounds": _CHUNKS + f" SELECT chunk_id, a AS first_sentence, e AS end_sentence, {c.sql_estimate('content_text')} AS token_count, length(content_text)::BIGINT AS char_count FROM made",
    "chunks": _CHUNKS
    + r""" SELECT chunk_id, paper_id, section_title, section_id, content_text, '[Document: ' || paper_title || ' | Section: ' || section_title || ' | ' || CASE WHEN len(pages) = 1 THEN 'Page ' || pages[1] ELSE 'Pages ' || pages[1] || '-' || pages[-1] END || ']' || chr(10) || chr(10) || content_text AS embed_text,
    array_to_string(pages, ',') AS page_numbers, array_to_string(bls, ',') AS source_block_ids, CASE WHEN regexp_matches(lower(section_title), '\b(references?|bibliography|works cited)\b') THEN 'reference' ELSE 'prose' END AS chunk_type, regexp_matches(lower(section_title), '\b(references?|bibliography|works cited)\b') AS is_reference FROM made""",
    "chunk_stats": f"WITH {c.SQL_CHUNKS} SELECT paper_id, count(*) AS n_chunks, round(avg(token_count), 6) AS mean_tokens, round(stddev_pop(token_count), 6) AS std_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, count(*) FILTER (len(page_numbers) > 1) AS multi_page FROM chk GROUP BY paper_id",
    "bm25_stats": _BM + " SELECT n_chunks, round(avg_len, 9) AS avg_len FROM corpus",
    "bm25_idf": _BM + " SELECT term, df, round(idf, 9) AS idf FROM idf",
    "bm25_search": _BM + ", one AS (SELECT 0 AS query_id, 'How does the sparse encoder affect the BLEU of a dense decoder?' AS query_text)" + _scores("one") + " SELECT chunk_id, score, rank FROM (" + _RANKED.format("sc") + ")",
    "bm25_batch": _BM + _scores("qry") + " " + _RANKED.format("sc"),
    "bm25_search_filtered": _BM
    + _scores("qry")
    + ", fl AS (SELECT sc.* FROM sc JOIN qry ON qry.query_id = sc.query_id JOIN chk ON chk.chunk_id = sc.chunk_id WHERE (nullif(filter_paper_id, '') IS NULL OR paper_id = filter_paper_id) AND (min_page IS NULL OR coalesce(list_max(page_numbers) >= min_page, false)) AND (max_page IS NULL OR coalesce(list_min(page_numbers) <= max_page, false))) "
    + _RANKED.format("fl"),
    "cosine_pairs": _VECS + " SELECT a.vec_id, round(array_cosine_similarity(a.v, b.v), 6) AS similarity FROM good a JOIN good b ON b.vec_id = a.vec_id + 1",
    "dense_topk": _VECS + ", s AS (SELECT vec_id, round(array_cosine_similarity(v, qv), 4) AS score FROM good, q) SELECT vec_id, score, round(1 - score, 4) AS distance, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10",
    "dot_topk": _VECS + ", s AS (SELECT vec_id, list_dot_product(v, list_transform(range(-32, 32), lambda x: x::DOUBLE)) AS s FROM good) SELECT vec_id, round(s, 4) AS score FROM s ORDER BY s DESC, vec_id LIMIT 10",
    "best_match": _VECS + ", s AS (SELECT a.vec_id AS query_id, b.vec_id, floor(array_cosine_similarity(a.v, b.v) * 10000 + 0.5) / 10000 AS similarity FROM good a JOIN good b ON a.vec_id % 50 = 0 AND b.vec_id % 2 = 1) SELECT query_id, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM s) WHERE rn = 1",
    "dense_topk_filtered": _VECS + ", s AS (SELECT vec_id, round(array_cosine_similarity(v, qv), 4) AS score FROM good, q WHERE page_number BETWEEN 2 AND 4 AND paper_id <> '2119_99999') SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10",
    "rrf_fusion": _RRF + " SELECT query_id, chunk_id, dense_rank, sparse_rank, rrf_score, position FROM fused",
    "hybrid_rerank": _RRF
    + f", {c.SQL_CHUNKS}, {c.SQL_QUERIES}, s AS (SELECT f.query_id, f.chunk_id, rrf_score, position, trim(coalesce(query_text, '')) <> '' AS asked, coalesce(len(list_intersect({c.sql_tokens('lower(query_text)')}, {c.sql_tokens('lower(content_text)')})), 0)::DOUBLE AS cs FROM fused f JOIN qry ON qry.query_id = f.query_id LEFT JOIN chk ON chk.chunk_id = f.chunk_id WHERE position <= 20)"
    + ", r AS (SELECT query_id, chunk_id, CASE WHEN asked THEN cs END AS cross_score, CASE WHEN asked THEN cs ELSE rrf_score END AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN asked THEN cs END DESC NULLS LAST, CASE WHEN asked THEN rrf_score END DESC NULLS LAST, CASE WHEN asked THEN 0 ELSE position END, chunk_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5",
    "upsert_idempotent": f"WITH {c.SQL_EMBEDDED} SELECT vec_id, paper_id, page_number FROM emb",
    "delete_paper": f"WITH {c.SQL_EMBEDDED} SELECT paper_id, count(*) AS n FROM emb WHERE paper_id IS DISTINCT FROM '2119_99999' GROUP BY paper_id",
    "deleted_rows": f"WITH {c.SQL_EMBEDDED}, {c.SQL_CHUNKS} SELECT greatest((SELECT count(*) FROM emb WHERE paper_id = '2119_99999'), (SELECT count(*) FROM chk WHERE paper_id = '2119_99999')) AS n",
    "indexed_papers": "WITH emb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC NULLS LAST, paper_id, page_number, section_title NULLS LAST, text NULLS LAST) AS rn FROM embedded_blocks) WHERE rn = 1) SELECT paper_id, min(coalesce(metadata['title'], paper_id)) AS paper_title, count(*) AS n_blocks, count(DISTINCT page_number) AS n_pages FROM emb GROUP BY paper_id",
    "collection_stats": f"WITH {c.SQL_EMBEDDED} SELECT count(*) AS n_blocks, count(DISTINCT paper_id) AS n_papers FROM emb",
    "stream_upsert": f"WITH {c.SQL_CHUNKS} SELECT chunk_id, paper_id, token_count FROM chk",
}
