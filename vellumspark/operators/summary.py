"""Extractive summaries of all documents at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.prose import Lemma, Split, Verb, contains_any, has_cue, is_acknowledgement, lemmas, prose_sentences, segment
from vellumspark.functions.stopwords import EXCLUDED_SECTIONS, GENERAL_STOPWORDS, SUMMARY_SECTIONS
from vellumspark.operators.keywords import document_keywords
from vellumspark.tables import cut


def salience(sentence: Column, weights: Column, stopwords: Sequence[str] = GENERAL_STOPWORDS, lemma: Lemma | None = None) -> Column:
    """Sum of the weights (a map from term to weight) of a sentence's tokens, repeats counted, over the root of their number; half as much again with a cue phrase. 0 without tokens or hits."""
    tokens = lemmas(sentence, stopwords, lemma)
    hit = F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at(weights, t), F.lit(0.0)))
    return F.when((F.size(tokens) == 0) | (hit == 0), F.lit(0.0)).otherwise(hit / F.sqrt(F.size(tokens).cast("double")) * F.when(has_cue(sentence), F.lit(1.5)).otherwise(F.lit(1.0)))


def keyword_map(keywords: DataFrame) -> DataFrame:
    """doc_id, weights: a document's keywords as a map; `keywords` has at most its top k terms for each document."""
    return keywords.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "score")))).alias("weights"))


def candidate_sentences(paragraphs: DataFrame, target: Sequence[str] | None = None, has_verb: Verb | None = None, split: Split = segment) -> DataFrame:
    """doc_id, title, first, ordinal, n, sentence: prose sentences of the sections that a summary draws on, no acknowledgements.

    (first, ordinal, n) is the order of reading: place of the section's first paragraph, of the paragraph, of the
    sentence. The sections are those whose title contains a part in `target`, by default abstract, introduction and
    conclusion where the document has one of them; excluded titles never count; where nothing is left, all other
    sections do.
    """
    low = F.lower("title")
    sections = paragraphs.groupBy("doc_id", "title").agg(F.min("ordinal").alias("first"))
    named = contains_any(low, tuple(target) if target else SUMMARY_SECTIONS)
    flags = sections.groupBy("doc_id").agg(F.max(named).alias("_some"))
    sections = sections.join(flags, "doc_id").withColumn("_wanted", F.lit(True) if target else F.col("_some"))
    sections = sections.where(~contains_any(low, EXCLUDED_SECTIONS)).select("doc_id", "title", "first", (~F.col("_wanted") | named).alias("_in"))
    sentences = paragraphs.join(sections, ["doc_id", "title"]).select("doc_id", "title", "first", "ordinal", "_in", F.posexplode(prose_sentences(F.col("text"), has_verb, split)).alias("n", "sentence"))
    sentences = sentences.where(~is_acknowledgement(F.col("sentence")))
    found = sentences.groupBy("doc_id").agg(F.max("_in").alias("_found"))
    return sentences.join(found, "doc_id").where("_in or not _found").drop("_in", "_found")


def score_sentences(candidates: DataFrame, keywords: DataFrame, stopwords: Sequence[str] = GENERAL_STOPWORDS, lemma: Lemma | None = None) -> DataFrame:
    """candidates with a score above 0."""
    return candidates.join(keyword_map(keywords), "doc_id").withColumn("score", salience(F.col("sentence"), F.col("weights"), stopwords, lemma)).where("score > 0").drop("weights")


def select_sentences(scored: DataFrame, sentences: int = 5, per_section: int = 2) -> DataFrame:
    """The sentences of each document's summary: by score, at most `per_section` a section, filled up by score alone."""
    order = [F.col("score").desc(), F.col("first"), F.col("ordinal"), F.col("n")]
    within = Window.partitionBy("doc_id", "title").orderBy(*order)
    # no section gives more than all sentences of a summary, which bounds what the next window sees of a document
    top = scored.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= sentences)
    late = F.when(F.col("_place") <= per_section, F.lit(0)).otherwise(F.lit(1)) if per_section else F.lit(0)
    overall = Window.partitionBy("doc_id").orderBy(late, *order)
    return top.withColumn("_rank", F.row_number().over(overall)).where(F.col("_rank") <= sentences).drop("_place", "_rank")


def summarise(paragraphs: DataFrame, sentences: int = 5, target: Sequence[str] | None = None, per_section: int = 2, keywords: int = 25, stopwords: Sequence[str] = GENERAL_STOPWORDS, lemma: Lemma | None = None, has_verb: Verb | None = None, split: Split = segment) -> DataFrame:
    """doc_id, summary: the chosen sentences in the order of reading. A document without any has no row."""
    paragraphs = cut(paragraphs)  # cleaned once: keywords, sections and sentences all read them
    scored = score_sentences(candidate_sentences(paragraphs, target, has_verb, split), document_keywords(paragraphs, keywords, stopwords, lemma), stopwords, lemma)
    chosen = select_sentences(scored, sentences, per_section)
    parts = F.array_sort(F.collect_list(F.struct("first", "ordinal", "n", "sentence")))
    return chosen.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["sentence"]), " ").alias("summary"))


def summarise_section(paragraphs: DataFrame, title: str = "conclusion", sentences: int = 2, **rules) -> DataFrame:
    return summarise(paragraphs, sentences, [title], sentences, **rules)
