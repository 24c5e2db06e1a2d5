"""Queries of TF-IDF, keywords and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.prose import lemmas
from vellumspark.functions.stopwords import ACKNOWLEDGEMENTS, AFFILIATIONS, CUES, EXCLUDED_SECTIONS, FIRST_PAGE_ADDRESSES, GENERAL_STOPWORDS, MATH_SIGNS, METADATA_TERMS, NO_PROSE_STARTS, SUMMARY_SECTIONS
from vellumspark.functions.text import search_terms
from vellumspark.operators import keywords as kw
from vellumspark.operators import summary
from vellumspark.operators import tfidf as t
from vellumspark.plans import common as c
from vellumspark.plans.common import blocks, chunks, papers, search_queries, sections


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select("chunk_id", lemmas(F.col("content_text")).alias("tokens"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return kw.section_paragraphs(blocks(spark, d), sections(spark, d), papers(spark, d))


def _idf(spark: SparkSession, d: str, smooth: bool) -> DataFrame:
    n = chunks(spark, d, "chunk_type").agg(F.count(F.lit(1)).alias("n"))
    return t.inverse_document_frequency(t.term_frequency(_tokens(spark, d), ["chunk_id"], "tokens"), n, smooth=smooth)


def q_tf(spark: SparkSession, d: str) -> DataFrame:
    return t.term_frequency(_tokens(spark, d), ["chunk_id"], "tokens").select("chunk_id", "term", "n", F.round("tf", 9).alias("tf"))


def q_idf_smooth(spark: SparkSession, d: str) -> DataFrame:
    return _idf(spark, d, True).select("term", "df", F.round("idf", 9).alias("idf"))


def q_idf_standard(spark: SparkSession, d: str) -> DataFrame:
    return _idf(spark, d, False).select("term", "df", F.round("idf", 9).alias("idf"))


def q_tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    tf = t.term_frequency(_tokens(spark, d), ["chunk_id"], "tokens")
    scores = t.tfidf(tf, _idf(spark, d, True)).withColumn("score", F.round("tfidf", 9))
    return t.top_terms(scores, ["chunk_id"], "score", 3).select("chunk_id", "term", "score", "rank")


def q_sparse_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Titles of papers against queries, by counts of terms."""
    count = lambda df, key, text: t.term_frequency(df.select(F.col(key).cast("string").alias("key"), search_terms(F.col(text)).alias("_t")), ["key"], "_t")
    pairs = t.sparse_cosine(count(search_queries(spark, d), "query_id", "query_text"), count(papers(spark, d), "doc_id", "title"), "key", "n")
    return pairs.select(F.col("a_key").alias("query_id"), F.col("b_key").alias("doc_id"), F.round("similarity", 9).alias("similarity"))


def q_section_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d)


def q_section_keywords(spark: SparkSession, d: str) -> DataFrame:
    return kw.section_keywords(_paragraphs(spark, d)).withColumn("score", F.round("score", 9))


def q_document_keywords(spark: SparkSession, d: str) -> DataFrame:
    return kw.document_keywords(_paragraphs(spark, d)).withColumn("score", F.round("score", 9))


def q_sentence_salience(spark: SparkSession, d: str) -> DataFrame:
    rows = _paragraphs(spark, d)
    scored = summary.score_sentences(summary.candidate_sentences(rows), kw.document_keywords(rows, 25))
    return scored.select("doc_id", "title", "ordinal", F.col("n").cast("bigint").alias("n"), F.round("score", 9).alias("score"))


def q_extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarise(_paragraphs(spark, d))


def q_section_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.summarise_section(_paragraphs(spark, d), "method")


QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}


def _lemmas(text: str) -> str:
    return f"list_filter({c.sql_tokens(f'lower({text})')}, lambda t: length(t) > 1 AND t NOT IN {c.sql_list(GENERAL_STOPWORDS)})"


_TF = f"""WITH {c.SQL_CHUNKS}, tok AS (SELECT chunk_id, {_lemmas('content_text')} AS tokens FROM chk),
tf AS (SELECT chunk_id, term, count(*) AS n, count(*)::DOUBLE / any_value(total) AS tf FROM (SELECT chunk_id, len(tokens) AS total, unnest(tokens) AS term FROM tok) GROUP BY chunk_id, term),
idf AS (SELECT term, count(*) AS df, (SELECT count(*) FROM chk) AS total FROM tf GROUP BY term)"""
_PARAGRAPHS = f"""WITH {c.SQL_PAPERS}, {c.SQL_SECTIONS}, {c.SQL_BLOCKS},
par AS (SELECT blk.doc_id, coalesce(nullif(sec.title, ''), CASE WHEN page_number = 1 THEN 'Abstract' ELSE 'General' END) AS title, ordinal, {c.sql_clean('text')} AS text
  FROM blk LEFT JOIN sec ON sec.doc_id = blk.doc_id AND sec.section_id = blk.section_id LEFT JOIN pap ON pap.doc_id = blk.doc_id
  WHERE block_type = 'paragraph' AND NOT coalesce(lower(trim(sec.title)) = lower(trim(pap.title)) AND sec.title <> '' AND pap.title <> '', false)
  AND NOT coalesce(CASE WHEN page_number > 1 THEN false ELSE contains(text, '@') OR {c.sql_contains_any('lower(text)', FIRST_PAGE_ADDRESSES + AFFILIATIONS)} OR (coalesce(pap.title, '') <> '' AND contains(lower(text), lower(coalesce(pap.title, '')))) END, false)),
paragraphs AS (SELECT * FROM par WHERE {c.sql_words('text')} >= 4),
words AS (SELECT doc_id, title, unnest({_lemmas('text')}) AS term FROM paragraphs),
n AS (SELECT doc_id, title, term, count(*) AS n FROM words GROUP BY ALL),
tot AS (SELECT doc_id, title, sum(n) AS total FROM n GROUP BY ALL),
idf AS (SELECT n.doc_id, term, ln((any_value(s) + 1) / (count(*) + 1)) + 1 AS idf FROM n JOIN (SELECT doc_id, count(*)::DOUBLE AS s FROM tot GROUP BY doc_id) k ON k.doc_id = n.doc_id GROUP BY n.doc_id, term),
skw AS (SELECT n.doc_id, n.title, n.term, n / total::DOUBLE * idf AS score FROM n JOIN tot ON tot.doc_id = n.doc_id AND tot.title = n.title JOIN idf ON idf.doc_id = n.doc_id AND idf.term = n.term),
dkw0 AS (SELECT d.doc_id, d.term, d.n / t.total::DOUBLE * idf AS score FROM (SELECT doc_id, term, sum(n) AS n FROM n GROUP BY ALL) d JOIN (SELECT doc_id, sum(total) AS total FROM tot GROUP BY doc_id) t ON t.doc_id = d.doc_id JOIN idf ON idf.doc_id = d.doc_id AND idf.term = d.term),
dkw AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM dkw0 WHERE score > 0 AND length(term) >= 3 AND NOT regexp_matches(term, '^\\p{{N}}+$') AND term NOT IN {c.sql_list(METADATA_TERMS)})"""
_KEYWORD = f"score > 0 AND length(term) >= 3 AND NOT regexp_matches(term, '^\\p{{N}}+$') AND term NOT IN {c.sql_list(METADATA_TERMS)}"
_PROSE = (
    f"({c.sql_words('sentence')} BETWEEN 3 AND 65 AND NOT (" + " OR ".join(f"starts_with(lower(sentence), '{s}')" for s in NO_PROSE_STARTS) + r") AND length(regexp_replace(sentence, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(sentence), 1) >= 0.65"
    f" AND NOT {c.sql_contains_any('sentence', MATH_SIGNS)}" + r" AND regexp_matches(sentence, '^\p{Lu}'))"
)


def _salience(wanted: str, force: bool) -> str:
    return f""", secs AS (SELECT doc_id, title, min(ordinal) AS first FROM paragraphs GROUP BY ALL),
flags AS (SELECT doc_id, bool_or({wanted}) AS anysec FROM secs GROUP BY doc_id),
use AS (SELECT secs.doc_id, title, first, (NOT {'true' if force else 'anysec'} OR {wanted}) AS inside FROM secs JOIN flags ON flags.doc_id = secs.doc_id WHERE NOT {c.sql_contains_any('lower(title)', EXCLUDED_SECTIONS)}),
sent0 AS (SELECT doc_id, title, first, ordinal, inside, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS sentence FROM (SELECT p.doc_id, p.title, first, ordinal, inside, list_filter({c.sql_segment('text')}, lambda sentence: {_PROSE}) AS s FROM paragraphs p JOIN use ON use.doc_id = p.doc_id AND use.title = p.title)),
sent1 AS (SELECT *, bool_or(inside) OVER (PARTITION BY doc_id) AS found FROM sent0 WHERE NOT {c.sql_contains_any('lower(sentence)', ACKNOWLEDGEMENTS)}),
sent AS (SELECT * FROM sent1 WHERE inside OR NOT found),
hits AS (SELECT s.doc_id, s.title, s.first, s.ordinal, s.n, any_value(s.sentence) AS sentence, count(*) AS tokens, coalesce(sum(k.score), 0) AS w FROM (SELECT *, unnest({_lemmas('sentence')}) AS term FROM sent) s LEFT JOIN dkw k ON k.rank <= 25 AND k.doc_id = s.doc_id AND k.term = s.term GROUP BY s.doc_id, s.title, s.first, s.ordinal, s.n),
scored AS (SELECT *, w / sqrt(tokens) * CASE WHEN {c.sql_contains_any('lower(sentence)', CUES)} THEN 1.5::DOUBLE ELSE 1 END AS score FROM hits WHERE w > 0)"""


def _summary(wanted: str, force: bool, sentences: int, per_section: int) -> str:
    # scores that are equal but for the order of their sums are made equal
    return (
        _PARAGRAPHS
        + _salience(wanted, force)
        + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY score DESC, first, ordinal, n) AS place FROM scored),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN place <= {per_section} THEN 0 ELSE 1 END, score DESC, first, ordinal, n) AS rank FROM placed)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY first, ordinal, n) AS summary FROM top WHERE rank <= {sentences} GROUP BY doc_id"""
    )


_DEFAULT = c.sql_contains_any("lower(title)", SUMMARY_SECTIONS)
_QT = f"WITH {c.SQL_QUERIES}, {c.SQL_PAPERS}, a AS (SELECT key, term, count(*) AS n FROM (SELECT query_id::VARCHAR AS key, unnest({c.sql_terms('query_text')}) AS term FROM qry) GROUP BY ALL), b AS (SELECT key, term, count(*) AS n FROM (SELECT doc_id AS key, unnest({c.sql_terms('title')}) AS term FROM pap) GROUP BY ALL)"
ORACLES = {
    "tf": _TF + " SELECT chunk_id, term, n, round(tf, 9) AS tf FROM tf",
    "idf_smooth": _TF + " SELECT term, df, round(ln((total + 1)::DOUBLE / (df + 1)) + 1, 9) AS idf FROM idf",
    "idf_standard": _TF + " SELECT term, df, round(ln(total::DOUBLE / df), 9) AS idf FROM idf",
    "tfidf_top_terms": _TF + ", s AS (SELECT chunk_id, tf.term, round(tf * (ln((total + 1)::DOUBLE / (df + 1)) + 1), 9) AS score FROM tf JOIN idf ON idf.term = tf.term), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS rank FROM s) SELECT chunk_id, term, score, rank FROM r WHERE rank <= 3",
    "sparse_cosine": _QT + ", na AS (SELECT key, sqrt(sum(n * n)) AS l FROM a GROUP BY key), nb AS (SELECT key, sqrt(sum(n * n)) AS l FROM b GROUP BY key) SELECT a.key AS query_id, b.key AS doc_id, round(sum(a.n * b.n) / any_value(na.l * nb.l), 9) AS similarity FROM a JOIN b ON a.term = b.term JOIN na ON na.key = a.key JOIN nb ON nb.key = b.key GROUP BY a.key, b.key",
    "section_paragraphs": _PARAGRAPHS + " SELECT doc_id, title, ordinal, text FROM paragraphs",
    "section_keywords": _PARAGRAPHS + f", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY score DESC, term) AS rank FROM skw WHERE {_KEYWORD}) SELECT doc_id, title, term, round(score, 9) AS score, rank FROM r WHERE rank <= 5",
    "document_keywords": _PARAGRAPHS + " SELECT doc_id, term, round(score, 9) AS score, rank FROM dkw WHERE rank <= 10",
    "sentence_salience": _PARAGRAPHS + _salience(_DEFAULT, False) + " SELECT doc_id, title, ordinal, n::BIGINT AS n, round(score, 9) AS score FROM scored",
    "extractive_summary": _summary(_DEFAULT, False, 5, 2),
    "section_summary": _summary("contains(lower(title), 'method')", True, 2, 2),
}
