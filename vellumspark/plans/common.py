"""What the queries share: current rows of the test tables in the operators' forms, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.tables import current_rows, load

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLACK = WS.replace("[", "[^", 1)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "papers"), ["doc_id"], "ingested_at")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "sections"), ["doc_id", "section_id"], "detected_at", ["title", "level", "parent_id"])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current content blocks with their place in the document: page, then number on the page."""
    rows = current_rows(load(spark, sf_dir, "content_blocks"), ["doc_id", "block_id"], "extracted_at", ["block_type", "text", "page_number", "section_id", "bbox"])
    number = F.regexp_extract("block_id", r"_block_(\d+)", 1).try_cast("bigint")
    return rows.withColumn("ordinal", F.coalesce("page_number", F.lit(0)).cast("bigint") * 100_000 + F.coalesce(number, F.lit(0)))


def chunks(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "chunks"), ["chunk_id"], "indexed_at", list(payload))


def embedded(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "embedded_blocks"), ["vec_id"], "embedded_at", list(payload))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "search_queries"), ["query_id"], "asked_at")


def _current(name: str, table: str, keys: str, ts: str, columns: str) -> str:
    order = ", ".join(f"{c} NULLS LAST" for c in columns.split(", "))
    return f"{name} AS (SELECT {keys}, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ts} DESC NULLS LAST, {order}) AS rn FROM {table}) WHERE rn = 1)"


SQL_PAPERS = _current("pap", "papers", "doc_id", "ingested_at", "paper_id, title, authors, publication_date, doi, arxiv_id, total_pages")
SQL_SECTIONS = _current("sec", "sections", "doc_id, section_id", "detected_at", "title, level, parent_id")
SQL_BLOCKS = (
    _current("blk0", "content_blocks", "doc_id, block_id", "extracted_at", "block_type, text, page_number, section_id, bbox")
    + r", blk AS (SELECT *, coalesce(page_number, 0)::BIGINT * 100000 + coalesce(try_cast(regexp_extract(block_id, '_block_(\d+)', 1) AS BIGINT), 0) AS ordinal FROM blk0)"
)
SQL_CHUNKS = _current("chk", "chunks", "chunk_id", "indexed_at", "content_text, embed_text, token_count, char_count, paper_id, paper_title, section_title, section_id, page_numbers, source_block_ids, chunk_type, is_reference")
SQL_EMBEDDED = _current("emb", "embedded_blocks", "vec_id", "embedded_at", "block_id, paper_id, text, page_number, section_title, embedding")
SQL_QUERIES = _current("qry", "search_queries", "query_id", "asked_at", "query_label, query_text, filter_paper_id, min_page, max_page")


def sql_clean(text: str) -> str:
    """The cleaning rules; a mail address begins at the first word character of its run, as it does in the rule."""
    t = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}_])-{WS}*\n{WS}*([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '\[\p{{Nd}}+(?:(?:[,–-]|{WS})+\p{{Nd}}+)*\]', '', 'g')"
    t = rf"regexp_replace({t}, 'https?://{BLACK}+|www\.{BLACK}+', '', 'g')"
    t = rf"regexp_replace({t}, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.-]*@[\p{{L}}\p{{N}}_.-]+\.[\p{{L}}\p{{N}}_]+', '', 'g')"
    return rf"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def sql_terms(text: str) -> str:
    return f"coalesce(regexp_extract_all(lower({text}), '[a-z0-9]+(?:[-_.][a-z0-9]+)*'), [])"


def sql_tokens(text: str) -> str:
    return rf"coalesce(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), [])"


def sql_words(text: str) -> str:
    return f"coalesce(len(regexp_extract_all({text}, '{BLACK}+')), 0)"


def sql_estimate(text: str) -> str:
    return f"(CASE WHEN {sql_words(text)} = 0 THEN 0 ELSE greatest(1, floor({sql_words(text)} * 1.3::DOUBLE)::BIGINT) END)::BIGINT"


def sql_segment(text: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '{WS}+', ' ', 'g'))), lambda s: s <> '')"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_contains_any(text: str, parts) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, p.replace("'", "''")) for p in parts) + ")"
