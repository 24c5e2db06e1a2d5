"""Queries of the text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import metadata as md
from vellumspark.functions.headings import heading_level, heading_number
from vellumspark.functions.prose import is_acknowledgement, is_header_noise, is_prose, is_reference_title, segment, without_stopwords
from vellumspark.functions.stopwords import ACKNOWLEDGEMENTS, AFFILIATIONS, FIRST_PAGE_ADDRESSES, GENERAL_STOPWORDS, MATH_SIGNS, NO_PROSE_STARTS
from vellumspark.functions.text import clean_text, preprocess, search_terms, token_estimate, tokenize
from vellumspark.operators.enrichment import enrich, match_titles, title_or_first_block
from vellumspark.plans import common as c
from vellumspark.plans.common import blocks, chunks, papers, sections
from vellumspark.tables import load


def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("doc_id", "block_id", clean_text(F.col("text")).alias("cleaned"))


def q_normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select("chunk_id", F.array_join(preprocess(F.col("content_text")), " ").alias("tokens"))


def q_stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select("chunk_id", F.array_join(without_stopwords(tokenize(F.col("content_text"))), " ").alias("tokens"))


def q_bm25_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "embed_text").select("chunk_id", F.array_join(search_terms(F.col("embed_text")), " ").alias("terms"))


def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select("chunk_id", token_estimate(F.col("content_text")).alias("tokens"))


def q_sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select("chunk_id", F.posexplode(segment(F.col("content_text"))).alias("n", "sentence")).select("chunk_id", F.col("n").cast("bigint").alias("n"), "sentence")


def q_prose_sentences(spark: SparkSession, d: str) -> DataFrame:
    return q_sentence_split(spark, d).select("chunk_id", "n", is_prose(F.col("sentence")).alias("prose"), is_acknowledgement(F.col("sentence")).alias("thanks"))


def q_header_noise(spark: SparkSession, d: str) -> DataFrame:
    rows = blocks(spark, d).join(papers(spark, d).select("doc_id", "title"), "doc_id", "left")
    return rows.select("doc_id", "block_id", F.coalesce(is_header_noise(F.col("text"), F.col("page_number"), F.col("title")), F.lit(False)).alias("noise"))


def q_numbered_headings(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).where("block_type = 'heading'").select("doc_id", "block_id", heading_number(F.col("text")).alias("number"), heading_level(F.col("text")).alias("level"))


def q_reference_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("doc_id", "section_id", is_reference_title(F.col("title")).alias("is_reference"))


def q_paper_id(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("arxiv_id"), F.col("doi"), F.col("title"))
    return papers(spark, d).select("doc_id", md.paper_key(*key).alias("chunk_key"), md.paper_key(*key, sanitise=False).alias("store_key"))


def q_parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in five ways and read again."""
    day = F.col("publication_date")
    forms = {"iso": F.date_format(day, "yyyy-MM-dd"), "long": F.date_format(day, "d MMMM yyyy"), "american": F.date_format(day, "MMM d, yyyy"), "year": F.concat(F.lit("Proc. "), F.date_format(day, "yyyy")), "none": F.lit("undated")}
    return papers(spark, d).where("publication_date is not null").select("doc_id", *[md.parse_date(v).alias(k) for k, v in forms.items()])


def q_doi_arxiv_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", F.lit("Preprint"), F.concat(F.lit("ArXiv:"), "arxiv_id"), F.concat(F.lit("doi: "), "doi", F.lit(" (2020)")))
    return papers(spark, d).select("doc_id", md.find_doi(text).alias("found_doi"), md.find_arxiv_id(text).alias("found_arxiv"), md.doi_or_arxiv(md.find_doi(text), md.find_arxiv_id(text)).alias("any_doi"))


def q_author_list(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("doc_id", F.size(md.split_authors(F.array_join("authors", " ,, "))).cast("bigint").alias("n_authors"), md.join_list(F.col("authors")).alias("joined"))


def q_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "content_text").select("chunk_id", F.sha2("content_text", 256).alias("hash"))


def q_title_match(spark: SparkSession, d: str) -> DataFrame:
    """Papers matched by title with the titles that chunks bear."""
    records = load(spark, d, "chunks").where("paper_title is not null").select(F.col("paper_title").alias("title"), F.col("paper_id").alias("record_id")).distinct().withColumn("place", F.lit(0))
    records = records.groupBy("record_id").agg(F.min("title").alias("title"), F.min("place").alias("place"))
    return match_titles(papers(spark, d).select("doc_id", "title"), records).select("doc_id", "record_id", F.round("similarity", 6).alias("similarity"))


def q_title_fallback(spark: SparkSession, d: str) -> DataFrame:
    return title_or_first_block(papers(spark, d).select("doc_id", "title"), blocks(spark, d)).select("doc_id", "title")


def q_metadata_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Papers enriched from records known by DOI, arXiv id or title."""
    p = papers(spark, d)
    fields = [F.upper("title").alias("title"), "authors", F.add_months("publication_date", 1).alias("published"), F.lit("").alias("found_doi")]
    by_doi = p.where("doi is not null and total_pages > 3").groupBy("doi").agg(F.min("title").alias("title"), F.lit(None).cast("array<string>").alias("authors"), F.min("publication_date").alias("published")).select("doi", F.upper("title").alias("title"), "authors", "published", F.col("doi").alias("found_doi"))
    by_arxiv = p.where("arxiv_id is not null").groupBy("arxiv_id").agg(F.lit("").alias("title"), F.array(F.lit("A. One")).alias("authors"), F.lit(None).cast("date").alias("published"), F.lit("").alias("found_doi"))
    by_title = p.select("doc_id", *fields)
    return enrich(p, by_doi, by_arxiv, by_title).select("doc_id", "title", F.array_join("authors", "; ").alias("authors"), "publication_date", "doi", "arxiv_id")


_NUMBER = rf"(?:^)(?:{c.WS})*([A-Z](?:\.\p{{Nd}}+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)*|[IVX]+)\.?(?:{c.WS})+[^\n]+"
_PROSE = (
    f"({c.sql_words('sentence')} BETWEEN 3 AND 65 AND NOT (" + " OR ".join(f"starts_with(lower(sentence), '{s}')" for s in NO_PROSE_STARTS) + r") AND length(regexp_replace(sentence, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(sentence), 1) >= 0.65"
    f" AND NOT {c.sql_contains_any('sentence', MATH_SIGNS)}" + r" AND regexp_matches(sentence, '^\p{Lu}'))"
)
_SENTENCES = f"WITH {c.SQL_CHUNKS}, sent AS (SELECT chunk_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS sentence FROM (SELECT chunk_id, {c.sql_segment('content_text')} AS s FROM chk WHERE content_text IS NOT NULL))"
_TITLE = "list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ')), lambda w: w <> '')"

QUERIES = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLES = {
    "clean_text": f"WITH {c.SQL_BLOCKS} SELECT doc_id, block_id, {c.sql_clean('text')} AS cleaned FROM blk",
    "normalize_tokens": f"WITH {c.SQL_CHUNKS} SELECT chunk_id, array_to_string({c.sql_tokens('lower(content_text)')}, ' ') AS tokens FROM chk",
    "stopword_filter": f"WITH {c.SQL_CHUNKS} SELECT chunk_id, array_to_string(list_filter({c.sql_tokens('content_text')}, lambda t: lower(t) NOT IN {c.sql_list(GENERAL_STOPWORDS)}), ' ') AS tokens FROM chk",
    "bm25_tokenize": f"WITH {c.SQL_CHUNKS} SELECT chunk_id, array_to_string({c.sql_terms('embed_text')}, ' ') AS terms FROM chk",
    "token_estimate": f"WITH {c.SQL_CHUNKS} SELECT chunk_id, {c.sql_estimate('content_text')} AS tokens FROM chk",
    "sentence_split": _SENTENCES + " SELECT chunk_id, n::BIGINT AS n, sentence FROM sent",
    "prose_sentences": _SENTENCES + f" SELECT chunk_id, n::BIGINT AS n, {_PROSE} AS prose, {c.sql_contains_any('lower(sentence)', ACKNOWLEDGEMENTS)} AS thanks FROM sent",
    "header_noise": f"WITH {c.SQL_BLOCKS}, {c.SQL_PAPERS} SELECT blk.doc_id, block_id, coalesce(CASE WHEN page_number > 1 THEN false ELSE contains(text, '@') OR {c.sql_contains_any('lower(text)', FIRST_PAGE_ADDRESSES + AFFILIATIONS)} OR (coalesce(title, '') <> '' AND contains(lower(text), lower(coalesce(title, '')))) END, false) AS noise FROM blk LEFT JOIN pap ON pap.doc_id = blk.doc_id",
    "numbered_headings": f"WITH {c.SQL_BLOCKS}, h AS (SELECT doc_id, block_id, nullif(regexp_extract(text, '{_NUMBER}', 1), '') AS number FROM blk WHERE block_type = 'heading') SELECT doc_id, block_id, number, len(string_split(number, '.'))::BIGINT AS level FROM h",
    "reference_sections": rf"WITH {c.SQL_SECTIONS} SELECT doc_id, section_id, coalesce(regexp_matches(lower(title), '\b(references?|bibliography|works cited)\b'), false) AS is_reference FROM sec",
    "paper_id": f"WITH {c.SQL_PAPERS}, k AS (SELECT doc_id, coalesce(nullif(arxiv_id, ''), nullif(doi, ''), left(replace(lower(coalesce(nullif(title, ''), 'paper')), ' ', '_'), 50)) AS store_key FROM pap) SELECT doc_id, regexp_replace(store_key, '[^a-zA-Z0-9_-]', '_', 'g') AS chunk_key, store_key FROM k",
    "parse_dates": f"WITH {c.SQL_PAPERS} SELECT doc_id, publication_date AS iso, publication_date AS long, publication_date AS american, make_date(year(publication_date), 12, 1) AS year, NULL::DATE AS none FROM pap WHERE publication_date IS NOT NULL",
    "doi_arxiv_extract": f"WITH {c.SQL_PAPERS} SELECT doc_id, doi AS found_doi, arxiv_id AS found_arxiv, coalesce(doi, '10.48550/arXiv.' || arxiv_id) AS any_doi FROM pap",
    "author_list": f"WITH {c.SQL_PAPERS} SELECT doc_id, coalesce(len(list_filter(authors, lambda a: trim(a) <> '')), 0)::BIGINT AS n_authors, array_to_string(list_transform(authors, lambda a: coalesce(a, 'None')), ', ') AS joined FROM pap",
    "content_hash": f"WITH {c.SQL_CHUNKS} SELECT chunk_id, sha256(content_text) AS hash FROM chk",
    "title_match": f"""WITH {c.SQL_PAPERS}, rec AS (SELECT paper_id AS record_id, min(paper_title) AS title FROM chunks WHERE paper_title IS NOT NULL GROUP BY paper_id),
      p AS (SELECT doc_id, {_TITLE.format('title')} AS w FROM pap), r AS (SELECT record_id, {_TITLE.format('title')} AS w FROM rec),
      s AS (SELECT doc_id, record_id, len(list_intersect(p.w, r.w))::DOUBLE / len(list_distinct(list_concat(p.w, r.w))) AS similarity FROM p JOIN r ON len(p.w) > 0 AND len(r.w) > 0 AND list_has_any(p.w, r.w))
      SELECT doc_id, record_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY record_id) AS rn FROM s WHERE similarity >= 0.7) WHERE rn = 1""",
    "title_fallback": f"WITH {c.SQL_PAPERS}, {c.SQL_BLOCKS}, f AS (SELECT doc_id, trim(text) AS first FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, block_id) AS rn FROM blk WHERE text IS NOT NULL) WHERE rn = 1) SELECT pap.doc_id, CASE WHEN title IS NULL OR title = '' OR contains(lower(title), '.pdf') THEN coalesce(first, title) ELSE title END AS title FROM pap LEFT JOIN f ON f.doc_id = pap.doc_id",
    "metadata_enrich": f"""WITH {c.SQL_PAPERS}, bd AS (SELECT doi, upper(min(title)) AS t, min(publication_date) AS d FROM pap WHERE doi IS NOT NULL AND total_pages > 3 GROUP BY doi)
      SELECT pap.doc_id, CASE WHEN bd.doi IS NOT NULL THEN coalesce(nullif(bd.t, ''), title) WHEN arxiv_id IS NOT NULL THEN title ELSE coalesce(nullif(upper(title), ''), title) END AS title,
      coalesce(array_to_string(CASE WHEN bd.doi IS NOT NULL THEN authors WHEN arxiv_id IS NOT NULL THEN ['A. One'] ELSE authors END, '; '), '') AS authors,
      CASE WHEN bd.doi IS NOT NULL THEN coalesce(bd.d, publication_date) WHEN arxiv_id IS NOT NULL THEN publication_date ELSE coalesce((publication_date + INTERVAL 1 MONTH)::DATE, publication_date) END AS publication_date,
      coalesce(pap.doi, '10.48550/arXiv.' || arxiv_id) AS doi, arxiv_id FROM pap LEFT JOIN bd ON bd.doi = pap.doi""",
}
