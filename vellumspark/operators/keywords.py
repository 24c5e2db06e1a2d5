"""Section paragraphs and keywords of documents, all documents at once.

`blocks` has doc_id, block_id, ordinal (place in the document), block_type, text, page_number, section_id; `sections` has
doc_id, section_id, title; `papers` has doc_id and the paper's title.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.prose import Lemma, is_content, is_header_noise, is_keyword, word_tokens
from vellumspark.functions.stopwords import GENERAL_STOPWORDS
from vellumspark.functions.text import clean_text, strip_ws, word_count
from vellumspark.operators.tfidf import inverse_document_frequency, tfidf, top_terms
from vellumspark.tables import cut


def section_paragraphs(blocks: DataFrame, sections: DataFrame, papers: DataFrame, least_words: int = 4) -> DataFrame:
    """doc_id, title, ordinal, text: the cleaned body paragraphs with the title of their section.

    Headings, first-page addresses and affiliations, sections named like the paper, and paragraphs of fewer than
    `least_words` words are left out. Without a section title a paragraph belongs to "Abstract" on page 1, else to
    "General". Sections of the same title are one.
    """
    paper = papers.select("doc_id", F.col("title").alias("_paper"))
    titled = sections.select("doc_id", "section_id", F.col("title").alias("_title"))
    rows = blocks.where("block_type = 'paragraph'").join(titled, ["doc_id", "section_id"], "left").join(paper, "doc_id", "left")
    own_name = F.coalesce((F.lower(strip_ws("_title")) == F.lower(strip_ws("_paper"))) & (F.col("_title") != "") & (F.col("_paper") != ""), F.lit(False))
    noise = F.coalesce(is_header_noise(F.col("text"), F.col("page_number"), F.col("_paper")), F.lit(False))
    title = F.coalesce(F.nullif("_title", F.lit("")), F.when(F.col("page_number") == 1, F.lit("Abstract")).otherwise(F.lit("General")))
    out = rows.where(~noise & ~own_name).select("doc_id", title.alias("title"), "ordinal", clean_text(F.col("text")).alias("text"))
    return out.where(word_count(F.col("text")) >= least_words)


def section_keywords(paragraphs: DataFrame, k: int = 5, stopwords: Sequence[str] = GENERAL_STOPWORDS, lemma: Lemma | None = None) -> DataFrame:
    """doc_id, title, term, score, rank: the k terms with the highest TF-IDF of each section, each section a document of its paper."""
    tf, idf = _section_statistics(paragraphs, stopwords, lemma)
    scores = tfidf(tf, idf, ["doc_id"]).where((F.col("tfidf") > 0) & is_keyword(F.col("term")))
    return top_terms(scores, ["doc_id", "title"], "tfidf", k).select("doc_id", "title", "term", F.col("tfidf").alias("score"), "rank")


def document_keywords(paragraphs: DataFrame, k: int = 10, stopwords: Sequence[str] = GENERAL_STOPWORDS, lemma: Lemma | None = None) -> DataFrame:
    """doc_id, term, score, rank: term frequencies over the whole paper, document frequencies over its sections."""
    tf, idf = _section_statistics(paragraphs, stopwords, lemma)
    sums = tf.groupBy("doc_id", "term").agg(F.sum("n").alias("n"))
    total = sums.groupBy("doc_id").agg(F.sum("n").alias("_all"))
    whole = sums.join(total, "doc_id").select("doc_id", "term", (F.col("n") / F.col("_all")).alias("tf"))
    scores = tfidf(whole, idf, ["doc_id"]).where((F.col("tfidf") > 0) & is_keyword(F.col("term")))
    return top_terms(scores, ["doc_id"], "tfidf", k).select("doc_id", "term", F.col("tfidf").alias("score"), "rank")


def _section_statistics(paragraphs: DataFrame, stopwords: Sequence[str], lemma: Lemma | None) -> tuple[DataFrame, DataFrame]:
    # stop words are dropped from rows, in generated code, rather than from arrays; counts of paragraphs are added to counts
    # of sections, so that no section's text is ever put together; and they are made once: totals, shares and document
    # frequencies all read them
    tokens = paragraphs.select("doc_id", "title", F.explode(word_tokens(F.col("text"))).alias("term")).where(is_content(F.col("term"), stopwords))
    if lemma:  # a column of single tokens, so an Arrow UDF will do
        tokens = tokens.select("doc_id", "title", F.lower(lemma(F.col("term"))).alias("term")).where(F.length("term") > 1)
    n = cut(tokens.groupBy("doc_id", "title", "term").agg(F.count(F.lit(1)).alias("n")))
    total = n.groupBy("doc_id", "title").agg(F.sum("n").alias("_all"))
    tf = n.join(total, ["doc_id", "title"]).select("doc_id", "title", "term", "n", (F.col("n") / F.col("_all")).alias("tf"))
    documents = total.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return tf, inverse_document_frequency(tf, documents, ["doc_id"])

