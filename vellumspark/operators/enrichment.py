"""Metadata from other sources: joins with tables of records, and readers of their formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.metadata import doi_or_arxiv, parse_date, title_similarity, title_words
from vellumspark.functions.text import collapse_ws

# The schema of the parts of a works record that are read, and the names of an Atom entry.
WORK = "title array<string>, DOI string, published struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string>>"


def read_work(json: Column) -> Column:
    """A works record (JSON) as struct<title, published, doi, authors>; missing month and day are 1."""
    work = F.from_json(json, WORK)
    date = F.get(work["published"]["date-parts"], F.lit(0))
    part = lambda i: F.coalesce(F.get(date, F.lit(i)), F.lit(1))
    authors = F.transform(work["author"], lambda a: F.trim(F.concat_ws(" ", F.coalesce(a["given"], F.lit("")), F.coalesce(a["family"], F.lit("")))))
    return F.struct(F.get(work["title"], F.lit(0)).alias("title"), F.when(F.get(date, F.lit(0)).isNotNull(), F.make_date(F.get(date, F.lit(0)), part(1), part(2))).alias("published"), work["DOI"].alias("doi"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"))


def read_atom_entry(xml: Column) -> Column:
    """An Atom feed's first entry as struct<title, published, doi, authors, arxiv_id>."""
    path = lambda p: F.xpath_string(xml, F.lit(p))
    entry = "//*[local-name()='entry'][1]"
    ident = F.split(F.element_at(F.split(path(f"{entry}/*[local-name()='id']"), "/abs/"), -1), "v")[0]
    doi = F.nullif(F.trim(path(f"{entry}/*[local-name()='doi']")), F.lit(""))
    authors = F.transform(F.xpath(xml, F.lit(f"{entry}/*[local-name()='author']/*[local-name()='name']/text()")), F.trim)
    return F.struct(collapse_ws(path(f"{entry}/*[local-name()='title']")).alias("title"), parse_date(F.trim(path(f"{entry}/*[local-name()='published']"))).alias("published"), doi_or_arxiv(doi, ident).alias("doi"), authors.alias("authors"), ident.alias("arxiv_id"))


def match_titles(papers: DataFrame, records: DataFrame, threshold: float = 0.70, key: str = "doc_id") -> DataFrame:
    """key, record_id, similarity: for each paper the first record (by `place`, then record_id) whose title is similar enough.

    papers have key and title, records have record_id, title and place. Titles that reach the threshold share a word, and
    by prefix filtering one of a title's rarest words: of n words the n - ceil(threshold * n) + 1 rarest are enough, so
    words that stand in most titles pair nothing.
    """
    p = papers.select(F.col(key).alias("_p"), F.col("title").alias("_pt"), title_words(F.col("title")).alias("_pw"))
    r = records.select("record_id", "place", F.col("title").alias("_rt"), title_words(F.col("title")).alias("_rw"))
    words = p.select(F.explode("_pw").alias("w")).unionByName(r.select(F.explode("_rw").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("_df"))

    def rarest(df: DataFrame, ident: str, column: str) -> DataFrame:
        each = df.select(ident, F.size(column).alias("_n"), F.explode(column).alias("w")).join(words, "w")
        order = Window.partitionBy(ident).orderBy("_df", "w")  # as many rows as a title has words
        return each.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9) + 1).select(ident, "w")

    pairs = rarest(p, "_p", "_pw").join(rarest(r, "record_id", "_rw"), "w").select("_p", "record_id").distinct()
    scored = pairs.join(p.select("_p", "_pt"), "_p").join(r.select("record_id", "place", "_rt"), "record_id").withColumn("similarity", title_similarity(F.col("_pt"), F.col("_rt"))).where(F.col("similarity") >= threshold)
    first = scored.groupBy("_p").agg(F.min_by(F.struct("record_id", "similarity"), F.struct("place", "record_id")).alias("_m"))
    return first.select(F.col("_p").alias(key), "_m.record_id", "_m.similarity")


def enrich(papers: DataFrame, by_doi: DataFrame, by_arxiv: DataFrame, by_title: DataFrame) -> DataFrame:
    """papers (doc_id, title, authors, publication_date, doi, arxiv_id) with the fields of the first source that knows them.

    by_doi has doi, by_arxiv arxiv_id and by_title doc_id besides title, authors, published, found_doi. One source alone
    is used for a paper: the first of DOI, arXiv id, title; each of its fields that is not empty wins.
    """
    found = lambda df, on, n: df.select(on, F.struct(F.col("title").alias("t"), F.col("authors").alias("a"), F.col("published").alias("d"), F.col("found_doi").alias("i")).alias(n))
    rows = papers.join(found(by_doi, "doi", "_1"), "doi", "left").join(found(by_arxiv, "arxiv_id", "_2"), "arxiv_id", "left").join(found(by_title, "doc_id", "_3"), "doc_id", "left")
    best = F.coalesce("_1", "_2", "_3")
    authors = F.when(F.size(best["a"]) > 0, best["a"])
    return rows.select(
        "doc_id",
        F.coalesce(F.nullif(best["t"], F.lit("")), F.col("title")).alias("title"),
        F.coalesce(authors, F.col("authors")).alias("authors"),
        F.coalesce(best["d"], F.col("publication_date")).alias("publication_date"),
        F.coalesce(F.nullif(best["i"], F.lit("")), doi_or_arxiv(F.col("doi"), F.col("arxiv_id"))).alias("doi"),
        "arxiv_id",
    )


def title_or_first_block(papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """papers with a title: where it is missing, empty or a file name, the text of the document's first block."""
    first = blocks.groupBy("doc_id").agg(F.min_by(F.trim("text"), F.struct("ordinal", "block_id")).alias("_first"))
    poor = F.col("title").isNull() | (F.col("title") == "") | F.contains(F.lower("title"), F.lit(".pdf"))
    return papers.join(first, "doc_id", "left").withColumn("title", F.when(poor, F.coalesce("_first", "title")).otherwise(F.col("title"))).drop("_first")
