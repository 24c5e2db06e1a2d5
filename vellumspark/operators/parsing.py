"""From raw layout blocks of many documents to papers, sections and content blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import metadata as md
from vellumspark.functions.text import strip_ws
from vellumspark.operators.enrichment import enrich, title_or_first_block
from vellumspark.operators.layout import detect_sections


def page_texts(raw: DataFrame, last_page: int = 2) -> DataFrame:
    """doc_id, page_number, page_text of the first pages, blocks in order. A page is all that comes together in a row."""
    front = raw.where(F.col("page_number") <= last_page)
    parts = front.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("_p"))
    return parts.select("doc_id", "page_number", F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("page_text"))


def local_metadata(raw: DataFrame, embedded: DataFrame) -> DataFrame:
    """doc_id, title, authors, publication_date, doi, arxiv_id, total_pages as far as the documents themselves tell.

    `embedded` has doc_id, title, author (names with commas), total_pages. A missing title is the first block's text,
    missing authors are the names in bold of the first block of page 1 that has any and is not the title or "abstract";
    the DOI is the first on pages 1 and 2; arXiv id and date come from page 1.
    """
    titled = title_or_first_block(embedded.select("doc_id", "title", "total_pages", md.split_authors(F.col("author")).alias("_authors")), raw)
    block = raw.where("page_number = 1").join(titled.select("doc_id", F.lower(F.coalesce("title", F.lit(""))).alias("_t")), "doc_id").withColumn("_low", F.lower(strip_ws("text")))
    other = (F.col("_low") != "abstract") & ~F.contains("_low", F.col("_t")) & ~F.contains("_t", F.col("_low"))
    names = block.where(other).withColumn("_names", md.author_names(F.col("spans"))).where(F.size("_names") > 0)
    names = names.groupBy("doc_id").agg(F.min_by("_names", "ordinal").alias("_names"))
    pages = page_texts(raw)
    doi = pages.withColumn("_doi", md.find_doi(F.col("page_text"))).where("_doi is not null").groupBy("doc_id").agg(F.min_by("_doi", "page_number").alias("doi"))
    first = pages.where("page_number = 1").select("doc_id", md.find_arxiv_id(F.col("page_text")).alias("arxiv_id"), md.first_page_date(F.col("page_text")).alias("publication_date"))
    rows = titled.join(names, "doc_id", "left").join(doi, "doc_id", "left").join(first, "doc_id", "left")
    authors = F.when(F.size("_authors") > 0, F.col("_authors")).otherwise(F.coalesce("_names", F.array().cast("array<string>")))
    return rows.select("doc_id", "title", authors.alias("authors"), "publication_date", "doi", "arxiv_id", "total_pages")


def parse_documents(raw: DataFrame, embedded: DataFrame, by_doi: DataFrame | None = None, by_arxiv: DataFrame | None = None, by_title: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, sections, content blocks); records of other sources (see enrichment.enrich) fill in where they are given."""
    papers = local_metadata(raw, embedded)
    spark = raw.sparkSession
    empty = lambda key: spark.createDataFrame([], f"{key} string, title string, authors array<string>, published date, found_doi string")
    rich = enrich(papers, *(given if given is not None else empty(key) for given, key in ((by_doi, "doi"), (by_arxiv, "arxiv_id"), (by_title, "doc_id"))))
    sections, blocks = detect_sections(raw)
    return rich.join(papers.select("doc_id", "total_pages"), "doc_id"), sections, blocks
