"""Queries of layout analysis and word vectors.

The tables hold blocks after section detection; their layout is laid out again from them: headings in bold 12 point,
paragraphs in 10 point, every seventh paragraph beginning with three bold words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.headings import formatting, is_false_heading, looks_unnumbered
from vellumspark.functions.text import strip_ws
from vellumspark.operators import layout, pooling, word2vec
from vellumspark.functions.stopwords import MATH_SIGNS, NO_PROSE_STARTS
from vellumspark.plans import common as c
from vellumspark.plans.common import blocks, chunks, search_queries

_SPANS = "array<struct<text:string,font_size:double,font:string,flags:int>>"


def raw_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d).where("text is not null and page_number is not null and bbox is not null and size(bbox) = 4")
    words = F.split("text", " ")
    span = lambda text, size, font, flags: F.struct(text.alias("text"), F.lit(size).alias("font_size"), F.lit(font).alias("font"), F.lit(flags).alias("flags"))
    lead, rest = F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, 4, F.size(words)), " ")
    inline = (F.col("ordinal") % 7 == 0) & (F.size(words) > 5)
    spans = F.when(F.col("block_type") == "heading", F.array(span(F.col("text"), 12.0, "Serif-Bold", 16))).when(inline, F.array(span(lead, 10.0, "Serif-Medi", 0), span(rest, 10.0, "Serif", 4))).otherwise(F.array(span(F.col("text"), 10.0, "Serif", 4)))
    return rows.select("doc_id", "block_id", "ordinal", "text", "page_number", "bbox", spans.cast(_SPANS).alias("spans"))


def q_inline_heading_split(spark: SparkSession, d: str) -> DataFrame:
    return layout.split_inline_headings(raw_blocks(spark, d)).select("doc_id", "block_id", "text")


def q_heading_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = raw_blocks(spark, d).withColumn("text", strip_ws("text")).where("text <> ''").withColumn("_f", formatting(F.col("spans")))
    return rows.select("doc_id", "block_id", looks_unnumbered(F.col("text"), F.col("_f.size"), F.col("_f.bold")).alias("unnumbered"), is_false_heading(F.col("text"), F.col("_f.size"), F.col("_f.first_size")).alias("false_heading"))


def _levelled(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d).where("text is not null and page_number is not null")
    level = F.when(F.col("block_type") == "heading", F.coalesce(F.size(F.split(F.nullif(F.regexp_extract("text", r"^(\d+(?:\.\d+)*) ", 1), F.lit("")), r"\.")), F.lit(2)))
    return rows.select("doc_id", "block_id", "ordinal", F.lit(0).alias("part"), level.cast("int").alias("level"))


def q_section_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return layout.section_hierarchy(_levelled(spark, d)).select("doc_id", "block_id", "level", "section_id", "parent_id")


def q_heading_merge(spark: SparkSession, d: str) -> DataFrame:
    return layout.merge_heading_lines(layout.split_inline_headings(raw_blocks(spark, d))).select("doc_id", "block_id", "text", "page_number")


def q_layout_sections(spark: SparkSession, d: str) -> DataFrame:
    return layout.detect_sections(raw_blocks(spark, d))[0]


def q_layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.detect_sections(raw_blocks(spark, d))[1].select("doc_id", "block_id", "block_type", "text", "page_number", "section_id")


def _word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for every word of the chunks, from its letters, so that SQL can make the same."""
    words = chunks(spark, d, "content_text").select(F.explode(F.regexp_extract_all(F.lower("content_text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double") - 109.0, F.ascii(F.reverse("word")).cast("double") - 109.0).alias("vector"))


def _query_words(spark: SparkSession, d: str) -> DataFrame:
    return search_queries(spark, d).select(F.col("query_id").alias("id"), F.coalesce(F.regexp_extract_all(F.lower("query_text"), F.lit("[a-z]+"), F.lit(0)), F.array().cast("array<string>")).alias("tokens"))


def q_pooled_sentence_vectors(spark: SparkSession, d: str) -> DataFrame:
    pooled = pooling.pool(_query_words(spark, d), _word_vectors(spark, d), 3)
    return pooled.select(F.col("id").alias("query_id"), *[F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in range(3)])


def q_analogy_topk(spark: SparkSession, d: str) -> DataFrame:
    return pooling.most_similar(_word_vectors(spark, d), ["encoder", "sparse"], ["decoder"], 5).select("word", F.round("similarity", 6).alias("similarity"))


def q_word_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("encoder", "decoder"), ("sparse", "dense"), ("the", "the")], "a string, b string")
    return pooling.word_similarity(_word_vectors(spark, d), pairs).withColumn("similarity", F.round("similarity", 6))


def q_training_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select("chunk_id", F.size(F.coalesce(pooling.training_sentences(F.col("content_text")), F.array().cast("array<array<string>>"))).cast("bigint").alias("n_sentences"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select(F.explode(pooling.training_sentences(F.col("content_text"))).alias("tokens"))


def q_corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return word2vec.corpus_totals(_sentences(spark, d))


def q_word2vec_train(spark: SparkSession, d: str) -> DataFrame:
    """Skip-gram by MLlib with its defaults but for the number of tasks: the vocabulary, and that every vector is finite."""
    vectors = pooling.train(_sentences(spark, d), partitions=8)
    return vectors.select("word", F.size("vector").cast("bigint").alias("dimensions"), F.forall("vector", lambda x: F.abs(x) < 1e6).alias("finite"))


def q_weighted_sentence_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Queries pooled with weights that grow with a word's letters; words of up to two letters have none."""
    asked = _query_words(spark, d)
    words = _word_vectors(spark, d)
    pooled = pooling.pool(asked, words, 3, words.select("word", (F.length("word") - 2).cast("double").alias("weight")))
    return pooled.select(F.col("id").alias("query_id"), *[F.round(F.get("vector", F.lit(i)), 6).alias(f"v{i}") for i in range(3)])


def q_sentence_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each query with the next."""
    asked = _query_words(spark, d)
    pairs = asked.select("id", F.col("tokens").alias("a")).join(asked.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("b")), "id")
    return word2vec.sentence_similarity(pairs, _word_vectors(spark, d), 3).select(F.col("id").alias("query_id"), F.round("similarity", 6).alias("similarity"))


_CASES = (
    # block_id, page, top, spans (text, size, bold)
    ("b01", 1, 0, [("Deep Paper Title", 16.0, True)]),
    ("b02", 1, 80, [("Ann Lee", 11.0, True)]),
    ("b03", 1, 160, [("Abstract", 12.0, True)]),
    ("b04", 1, 240, [("We study many things.", 10.0, False)]),
    ("b05", 1, 320, [("1 Introduction", 12.0, True)]),
    ("b06", 1, 400, [("See the parts", 12.0, True)]),
    ("b07", 2, 0, [("2.1 Small Head", 10.0, False)]),
    ("b08", 2, 80, [("2.1 Plain Large", 12.0, False)]),
    ("b09", 2, 160, [("Two Lines", 12.0, True)]),
    ("b10", 2, 175, [("Of Heading", 12.0, True)]),
    ("b11", 2, 240, [("Proof idea here", 10.0, True), ("It goes on.", 10.0, False)]),
    ("b12", 2, 320, [("tiny bold words", 9.0, True)]),
    ("b13", 3, 0, [("50 Things Counted", 12.0, True)]),
    ("b14", 3, 80, [("A.1 Proofs", 12.0, True)]),
    ("b15", 3, 160, [("1", 7.0, True), ("Footnote text", 12.0, True)]),
    ("b16", 3, 240, [("The end of it.", 10.0, False)]),
)


def _cases(spark: SparkSession) -> DataFrame:
    """A document by hand, one block for each rule."""
    rows = [("d", i, n, " ".join(t for t, _, _ in spans), page, [0.0, float(top), 300.0, top + 12.0], [(t, size, "Serif-Bold" if bold else "Serif", 0) for t, size, bold in spans]) for n, (i, page, top, spans) in enumerate(_CASES)]
    return spark.createDataFrame(rows, f"doc_id string, block_id string, ordinal bigint, text string, page_number int, bbox array<double>, spans {_SPANS}")


def q_layout_cases(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a document by hand after detection."""
    return layout.detect_sections(_cases(spark))[1].select("block_id", "block_type", "text", "section_id")


def q_layout_case_sections(spark: SparkSession, d: str) -> DataFrame:
    return layout.detect_sections(_cases(spark))[0].select("section_id", "title", "level", "parent_id")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}

_RAW = f"WITH {c.SQL_BLOCKS}, raw AS (SELECT *, string_split(text, ' ') AS w FROM blk WHERE text IS NOT NULL AND page_number IS NOT NULL AND len(bbox) = 4)"
_LEVELS = f"WITH {c.SQL_BLOCKS}, lv AS (SELECT doc_id, block_id, ordinal, CASE WHEN block_type = 'heading' THEN coalesce(len(string_split(nullif(regexp_extract(text, '^(\\d+(?:\\.\\d+)*) ', 1), ''), '.')), 2) END::INT AS level FROM blk WHERE text IS NOT NULL AND page_number IS NOT NULL)"
_VEC = f"WITH {c.SQL_CHUNKS}, {c.SQL_QUERIES}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(content_text), '[a-z]+')) AS word FROM chk), v AS (SELECT word, [length(word)::DOUBLE, ascii(word)::DOUBLE - 109, ascii(reverse(word))::DOUBLE - 109] AS vector FROM words)"
_FALSE = (
    f"{c.sql_words('t')} > 15 OR regexp_matches(lower(t), 'https?://|www\\.|@|arxiv:|arxiv preprint|doi:') OR length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) > 8 OR regexp_matches(t, '^(Note |See |For example,|Figure |Table |Fig\\. |Download |ISBN )')"
    " OR coalesce(try_cast(regexp_extract(number, '^\\d+', 0) AS DOUBLE) >= 50, false)"
)
_PROSE = (
    f"({c.sql_words('s')} BETWEEN 3 AND 65 AND NOT (" + " OR ".join(f"starts_with(lower(s), '{x}')" for x in NO_PROSE_STARTS) + r") AND length(regexp_replace(s, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(s), 1) >= 0.65"
    f" AND NOT {c.sql_contains_any('s', MATH_SIGNS)}" + r" AND regexp_matches(s, '^\p{Lu}'))"
)
_TRAIN = f"""WITH {c.SQL_CHUNKS}, sent AS (SELECT chunk_id, list_filter(list_transform(list_filter({c.sql_segment(c.sql_clean('content_text'))}, lambda s: {_PROSE}), lambda s: list_filter({c.sql_tokens('lower(s)')}, lambda t: length(t) > 1)), lambda t: len(t) >= 3) AS ts FROM chk),
tok AS (SELECT unnest(ts) AS t FROM sent), word AS (SELECT unnest(t) AS w FROM tok)"""
_POOLED = "q AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z]+')) AS word FROM qry)"
ORACLES = {
    "training_tokens": _TRAIN + " SELECT chunk_id, coalesce(len(ts), 0)::BIGINT AS n_sentences FROM sent",
    "corpus_totals": _TRAIN + " SELECT (SELECT count(*) FROM tok) AS n_sentences, (SELECT count(*) FROM word) AS n_tokens, (SELECT count(DISTINCT w) FROM word) AS n_words",
    "word2vec_train": _TRAIN + " SELECT w AS word, 100::BIGINT AS dimensions, true AS finite FROM word GROUP BY w HAVING count(*) >= 2",
    "weighted_sentence_vectors": _VEC
    + f""", {_POOLED}, p AS (SELECT query_id, sum((length(q.word) - 2) * vector[1]) / sum(length(q.word) - 2) AS a, sum((length(q.word) - 2) * vector[2]) / sum(length(q.word) - 2) AS b, sum((length(q.word) - 2) * vector[3]) / sum(length(q.word) - 2) AS c FROM q JOIN v ON v.word = q.word WHERE length(q.word) > 2 GROUP BY query_id)
    SELECT qry.query_id, round(coalesce(a, 0), 6) AS v0, round(coalesce(b, 0), 6) AS v1, round(coalesce(c, 0), 6) AS v2 FROM qry LEFT JOIN p ON p.query_id = qry.query_id""",
    "sentence_similarity": _VEC
    + f""", {_POOLED}, p AS (SELECT query_id, [avg(vector[1]), avg(vector[2]), avg(vector[3])] AS x FROM q JOIN v ON v.word = q.word GROUP BY query_id)
    SELECT a.query_id, round(coalesce(list_cosine_similarity(p.x, r.x), 0), 6) AS similarity FROM qry a JOIN qry b ON b.query_id = a.query_id + 1 LEFT JOIN p ON p.query_id = a.query_id LEFT JOIN p r ON r.query_id = b.query_id""",
    "layout_cases": """SELECT * FROM (VALUES ('b01', 'heading', 'Deep Paper Title', 'sec_1'), ('b02', 'paragraph', 'Ann Lee', 'sec_1'), ('b03', 'heading', 'Abstract', 'sec_2'), ('b04', 'paragraph', 'We study many things.', 'sec_2'),
    ('b05', 'heading', '1 Introduction', 'sec_3'), ('b06', 'paragraph', 'See the parts', 'sec_3'), ('b07', 'paragraph', '2.1 Small Head', 'sec_3'), ('b08', 'heading', '2.1 Plain Large', 'sec_4'), ('b09', 'heading', 'Two Lines Of Heading', 'sec_5'),
    ('b11_h', 'heading', 'Proof idea here', 'sec_6'), ('b11_p', 'paragraph', 'It goes on.', 'sec_6'), ('b12', 'paragraph', 'tiny bold words', 'sec_6'), ('b13', 'paragraph', '50 Things Counted', 'sec_6'), ('b14', 'heading', 'A.1 Proofs', 'sec_7'),
    ('b15', 'paragraph', '1 Footnote text', 'sec_7'), ('b16', 'paragraph', 'The end of it.', 'sec_7')) t(block_id, block_type, text, section_id)""",
    "layout_case_sections": """SELECT * FROM (VALUES ('sec_1', 'Deep Paper Title', 2, NULL), ('sec_2', 'Abstract', 2, NULL), ('sec_3', '1 Introduction', 1, NULL), ('sec_4', '2.1 Plain Large', 2, 'sec_3'),
    ('sec_5', 'Two Lines Of Heading', 2, 'sec_3'), ('sec_6', 'Proof idea here', 2, 'sec_3'), ('sec_7', 'A.1 Proofs', 2, 'sec_3')) t(section_id, title, level, parent_id)""",
    "inline_heading_split": _RAW
    + """, s AS (SELECT *, block_type <> 'heading' AND ordinal % 7 = 0 AND len(w) > 5 AS inline, trim(array_to_string(w[1:3], ' ')) AS lead, trim(array_to_string(w[4:], ' ')) AS rest FROM raw), """
    + f"k AS (SELECT *, inline AND {c.sql_words('lead')} BETWEEN 2 AND 10 AND rest <> '' AS cut FROM s) "
    + "SELECT doc_id, block_id || '_h' AS block_id, lead AS text FROM k WHERE cut UNION ALL SELECT doc_id, block_id || '_p', rest FROM k WHERE cut UNION ALL SELECT doc_id, block_id, text FROM k WHERE NOT cut",
    "heading_classify": _RAW
    + rf""", t AS (SELECT doc_id, block_id, block_type, ordinal, w, regexp_replace(text, '^{c.WS}+|{c.WS}+$', '', 'g') AS t FROM raw), n AS (SELECT *, nullif(regexp_extract(t, '^{c.WS}*([A-Z](?:\.\p{{Nd}}+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)*|[IVX]+)\.?{c.WS}+[^\n]+', 1), '') AS number FROM t WHERE t <> '')
    SELECT doc_id, block_id, (length(t) <= 120 AND NOT contains(t, chr(10)) AND number IS NULL AND {c.sql_words('t')} <= 12 AND block_type = 'heading') AS unnumbered, ({_FALSE}) AS false_heading FROM n""",
    "section_hierarchy": _LEVELS
    + """, n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY ordinal, block_id) AS k FROM lv), h AS (SELECT * FROM n WHERE level IS NOT NULL)
    SELECT n.doc_id, n.block_id, n.level, CASE WHEN n.k > 0 THEN 'sec_' || n.k END AS section_id, (SELECT 'sec_' || max(h.k) FROM h WHERE h.doc_id = n.doc_id AND h.k < n.k AND h.level < n.level) AS parent_id FROM n""",
    "pooled_sentence_vectors": _VEC
    + """, q AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z]+')) AS word FROM qry), p AS (SELECT query_id, avg(vector[1]) AS a, avg(vector[2]) AS b, avg(vector[3]) AS c FROM q JOIN v ON v.word = q.word GROUP BY query_id)
    SELECT qry.query_id, round(coalesce(a, 0), 6) AS v0, round(coalesce(b, 0), 6) AS v1, round(coalesce(c, 0), 6) AS v2 FROM qry LEFT JOIN p ON p.query_id = qry.query_id""",
    "analogy_topk": _VEC
    + """, u AS (SELECT word, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u FROM v),
    g AS (SELECT sum(s * u[1]) AS a, sum(s * u[2]) AS b, sum(s * u[3]) AS c FROM (SELECT u, CASE word WHEN 'decoder' THEN -1 ELSE 1 END AS s FROM u WHERE word IN ('encoder', 'sparse', 'decoder')))
    SELECT word, round((u[1] * a + u[2] * b + u[3] * c) / sqrt(a * a + b * b + c * c), 6) AS similarity FROM u, g WHERE word NOT IN ('encoder', 'sparse', 'decoder') ORDER BY (u[1] * a + u[2] * b + u[3] * c) DESC, word LIMIT 5""",
    "word_similarity": _VEC + " SELECT x.word AS a, y.word AS b, round(list_cosine_similarity(x.vector, y.vector), 6) AS similarity FROM v x, v y WHERE (x.word, y.word) IN (('encoder', 'decoder'), ('sparse', 'dense'), ('the', 'the'))",
}
