"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.text import clean_terms
from vellumspark.llm.distinctive import count_terms, least_score, log_entropy
from vellumspark.llm.encoding import encode_texts
from vellumspark.llm.frequency import term_frequencies
from vellumspark.llm.items import current_block_items, current_chunk_items, current_chunks, current_documents, current_items
from vellumspark.llm.leakage import leaked_items
from vellumspark.llm.neighbours import nearest, search
from vellumspark.llm.ranking import fuse_scores
from vellumspark.llm.reading import fit, fit_languages, item_table, reading_levels
from vellumspark.llm.sentences import sentence_bounds
from vellumspark.llm.splitting import pieces_hold, split_items
from vellumspark.tables import current_rows, load, written

ITEM = ["item_kind", "owner_id", "item_id"]


def _scored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind by itself: the rows of a kind lie by their key already, and a union would forget it and shuffle every posting."""
    kinds = []
    for items, table, key in ((current_chunk_items(spark, sf_dir), "chunks", ["chunk_id"]), (current_block_items(spark, sf_dir), "content_blocks", ["doc_id", "block_id"])):
        records = load(spark, sf_dir, table).select(*key).distinct().agg(F.count(F.lit(1)).alias("n"))  # without the texts
        kinds.append(log_entropy(count_terms(items, ITEM, clean_terms(F.col("text"))), records))
    return kinds[0].unionByName(kinds[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms distinctive enough to be at least 3 times in a record and in no more than 8 of its kind; of those the ones that are, in 2 at least."""
    distinctive = _scored_terms(spark, sf_dir).where(F.col("score") >= least_score(3, 8, F.col("n")))
    return distinctive.where((F.col("tf") >= 3) & F.col("df").between(2, 8)).select(*ITEM, "term")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every record with its weight and score."""
    return _scored_terms(spark, sf_dir).select(*ITEM, "term", "tf", "df", F.round("weight", 6).alias("weight"), F.round("score", 6).alias("score"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ["dense_score", "sparse_score", "cross_score"]
    hits = current_rows(load(spark, sf_dir, "hybrid_results"), ["query_id", "chunk_id"], "retrieved_at", scores)
    return fuse_scores(hits, "query_id", "chunk_id", scores)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of each query."""
    return _fused(spark, sf_dir).where("position = 1").select("query_id", "chunk_id")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with its fused score and position."""
    return _fused(spark, sf_dir).select("query_id", "chunk_id", F.round("fused", 9).alias("fused"), "position")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every sentence of every current chunk."""
    return sentence_bounds(current_chunks(spark, sf_dir, "content_text"), ["chunk_id"], "content_text").select("chunk_id", "end_char")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every current chunk with its place."""
    return sentence_bounds(current_chunks(spark, sf_dir, "content_text"), ["chunk_id"], "content_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be cut: those with a second piece."""
    return split_items(current_items(spark, sf_dir), ITEM, "text").where("n = 1").select(*ITEM)


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every chunk and block."""
    return split_items(current_items(spark, sf_dir), ITEM, "text")


def p5_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of every chunk and block tile its text, keep the limits and overlap."""
    return pieces_hold(current_items(spark, sf_dir), ITEM, "text")


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(current_chunks(spark, sf_dir, "content_text").select(clean_terms(F.col("content_text")).alias("terms")), "terms")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in exactly one current chunk or in more than 60 % of them."""
    return _frequencies(spark, sf_dir).where("mark is not null").select("term")


def p6_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return _frequencies(spark, sf_dir)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "embedded_blocks"), ["vec_id"], "embedded_at", ["embedding"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors with a cosine of 0.9 or more that are among each other's ten most similar."""
    near = nearest(_vectors(spark, sf_dir), "vec_id", "embedding", min_cosine=0.9)
    pair = near.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b"))
    return pair.groupBy("vec_id_a", "vec_id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("vec_id_a", "vec_id_b")


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector, however distant."""
    return nearest(_vectors(spark, sf_dir), "vec_id", "embedding")


def p7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors, however distant, of every vector whose number is divisible by 50."""
    return search(_vectors(spark, sf_dir), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every current document."""
    return encode_texts(current_documents(spark, sf_dir, "text"), ["doc_id"], "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(current_documents(spark, sf_dir, "text"), "doc_id", "text", load(spark, sf_dir, "eval_items").select("item_id", "text").distinct(), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a held-out item, with the item."""
    return _leaks(spark, sf_dir).where("size = 10").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and shorter items that are held whole, with the number of different windows found and their share of the item's."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "windows", F.round("contained", 6).alias("contained"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated level of every current document and the measures that go with it."""
    items = written(item_table(current_documents(spark, sf_dir, "text", "lang"), ["doc_id", "lang"], "text"))
    labels = load(spark, sf_dir, "doc_labels").select("doc_id", "reader_level", "rater").distinct()
    judged = items.join(labels, "doc_id").select("reader_level", "codes", "tf", "forms")
    return reading_levels(items, ["doc_id"], fit(items, judged, "reader_level", *fit_languages(items, "doc_id", "lang")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents on the easy side of the scale (1) or on the hard side (3), as far as they keep the exact limits."""
    levels = p10_levels(spark, sf_dir).where("lang = 'en' and n_words >= 40")
    band = F.when(F.col("level") < 0, F.lit(1)).when(F.col("level") > 0, F.lit(3))
    easy = (F.col("words_per_sentence") <= 10) & (F.col("letters_per_word") <= 3.8)
    hard = (F.col("words_per_sentence") >= 21) & (F.col("letters_per_word") >= 8.5)
    return levels.withColumn("band", band).where(((F.col("band") == 1) & easy) | ((F.col("band") == 3) & hard)).select("doc_id", "band")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_scores, p3_found, p3_ranking, p4_found, p4_sentences, p5_found, p5_pieces, p5_hold, p6_found, p6_frequencies, p7_found, p7_neighbours, p7_topk, p8_ids, p9_found, p9_leaks, p10_found, p10_levels)
}

_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLACK = _WS.replace("[", "[^", 1)


def _terms_sql(text: str) -> str:
    clean = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_])-{_WS}*\n{_WS}*([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    clean = rf"regexp_replace({clean}, '\[\p{{Nd}}+(?:[,–-]|{_WS})+\p{{Nd}}+(?:(?:[,–-]|{_WS})+\p{{Nd}}+)*\]|\[\p{{Nd}}+\]', '', 'g')"
    clean = rf"regexp_replace({clean}, 'https?://{_BLACK}+|www\.{_BLACK}+', '', 'g')"
    clean = rf"regexp_replace({clean}, '[\p{{L}}\p{{N}}_.-]*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.-]*@[\p{{L}}\p{{N}}_.-]+\.[\p{{L}}\p{{N}}_]+', '', 'g')"
    return rf"regexp_extract_all(lower({clean}), '[a-z0-9]+(?:[-_.][a-z0-9]+)*')"


_ITEMS = f"""
WITH items AS (
  SELECT 'chunk' AS item_kind, paper_id AS owner_id, chunk_id AS item_id, content_text AS text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, content_text) AS rn FROM chunks) WHERE rn = 1
  UNION ALL
  SELECT 'block', doc_id, block_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY extracted_at DESC, text) AS rn FROM content_blocks) WHERE rn = 1),
tokens AS (SELECT item_kind, owner_id, item_id, unnest({_terms_sql("text")}) AS term FROM items),
counts AS (SELECT item_kind, owner_id, item_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
weights AS (SELECT item_kind, term, count(*) AS df, greatest(ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf), 0) AS entropy FROM counts GROUP BY ALL),
sizes AS (SELECT item_kind, count(*) AS n FROM items GROUP BY ALL),
scored AS (SELECT c.*, df, greatest(0, 1 - entropy / ln(n)) AS weight FROM counts c JOIN weights w ON c.item_kind = w.item_kind AND c.term = w.term JOIN sizes s ON s.item_kind = c.item_kind)
"""

_FUSED = """
WITH cur AS (SELECT * FROM (SELECT query_id, chunk_id, dense_score d, sparse_score s, cross_score c, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY retrieved_at DESC, d NULLS LAST, s NULLS LAST, c NULLS LAST) AS rn FROM hybrid_results) WHERE rn = 1),
clean AS (SELECT query_id, chunk_id, CASE WHEN isnan(d) THEN NULL ELSE d END AS d, CASE WHEN isnan(s) THEN NULL ELSE s END AS s, CASE WHEN isnan(c) THEN NULL ELSE c END AS c FROM cur),
low AS (SELECT query_id, chunk_id, coalesce(d, min(d) OVER q) AS d, coalesce(s, min(s) OVER q) AS s, coalesce(c, min(c) OVER q) AS c FROM clean WINDOW q AS (PARTITION BY query_id)),
ranks AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY d DESC) AS rd, rank() OVER (PARTITION BY query_id ORDER BY s DESC) AS rs, rank() OVER (PARTITION BY query_id ORDER BY c DESC) AS rc FROM low),
fused AS (SELECT query_id, chunk_id, round(CASE WHEN d IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rd) END + CASE WHEN s IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rs) END + CASE WHEN c IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rc) END, 12) AS fused FROM ranks),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS position FROM fused)
"""

_FREQ = f"""
WITH cur AS (SELECT chunk_id, content_text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, content_text) AS rn FROM chunks) WHERE rn = 1),
tokens AS (SELECT chunk_id, unnest({_terms_sql("content_text")}) AS term FROM cur),
freq AS (SELECT term, count(*) AS occurrences, count(DISTINCT chunk_id) AS records FROM tokens GROUP BY term),
marked AS (SELECT *, CASE WHEN records <= 1 THEN 'rare' WHEN records > 0.6 * (SELECT count(*) FROM cur) THEN 'common' END AS mark FROM freq)
"""

_UNITS = """
WITH cur AS (SELECT vec_id, embedding FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC, embedding) AS rn FROM embedded_blocks) WHERE rn = 1),
good AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM cur WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
sims AS (SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.v, b.v) AS c FROM good a JOIN good b ON a.vec_id <> b.vec_id),
top AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS rn FROM sims) WHERE rn <= 10 AND c >= 0.9)
"""

_WORDS = r"""
WITH docs AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, text) AS rn FROM documents) WHERE rn = 1),
dwords AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(strip_accents(text)), '[\x{0300}-\x{036F}]', '', 'g'), '[\p{L}\p{N}]+') AS w FROM docs),
iwords AS (SELECT DISTINCT item_id, regexp_extract_all(regexp_replace(lower(strip_accents(text)), '[\x{0300}-\x{036F}]', '', 'g'), '[\p{L}\p{N}]+') AS w FROM eval_items),
igrams AS (SELECT DISTINCT item_id, list_aggregate(w[i:i+9], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iwords)),
dgrams AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i+9], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM dwords)),
sizes AS (SELECT item_id, count(*) AS n FROM igrams GROUP BY ALL),
leaks AS (SELECT doc_id, item_id, count(*) AS windows, round(count(*)::DOUBLE / any_value(n), 6) AS contained FROM dgrams JOIN igrams USING (g) JOIN sizes USING (item_id) GROUP BY ALL)
"""

ORACLES = {
    "p1_found": _ITEMS + "SELECT item_kind, owner_id, item_id, term FROM scored WHERE tf >= 3 AND df BETWEEN 2 AND 8",
    "p1_scores": _ITEMS + "SELECT item_kind, owner_id, item_id, term, tf, df, round(weight, 6) AS weight, round(log2(1 + tf) * weight, 6) AS score FROM scored",
    "p3_found": _FUSED + "SELECT query_id, chunk_id FROM placed WHERE position = 1",
    "p3_ranking": _FUSED + "SELECT query_id, chunk_id, round(fused, 9) AS fused, position FROM placed",
    "p5_found": _ITEMS.split("tokens AS")[0].rstrip().rstrip(",") + f" SELECT item_kind, owner_id, item_id FROM items WHERE length(text) > 2400 OR floor(len(regexp_extract_all(text, '{_BLACK}+')) * 1.3::DOUBLE) > 300",
    "p5_hold": _ITEMS.split("tokens AS")[0].rstrip().rstrip(",") + " SELECT item_kind, owner_id, item_id, true AS tiles, true AS within, true AS overlaps FROM items WHERE length(text) > 0",
    "p6_found": _FREQ + "SELECT term FROM marked WHERE mark IS NOT NULL",
    "p6_frequencies": _FREQ + "SELECT term, occurrences, records, mark FROM marked",
    "p7_found": _UNITS + "SELECT x.a AS vec_id_a, x.b AS vec_id_b FROM top x JOIN top y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
    "p9_found": _WORDS + "SELECT doc_id, item_id FROM leaks",
    "p9_leaks": _WORDS + "SELECT doc_id, item_id, windows, contained FROM leaks",
}
