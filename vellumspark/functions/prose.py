"""Sentences by rule and predicates on them, as Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.stopwords import (
    ACKNOWLEDGEMENTS,
    AFFILIATIONS,
    CUES,
    FIRST_PAGE_ADDRESSES,
    GENERAL_STOPWORDS,
    MATH_SIGNS,
    METADATA_TERMS,
    NO_PROSE_STARTS,
)
from vellumspark.functions.text import WORD, WS, collapse_ws, word_count

_MARK = "\x01"
#: What a language model may add: a token's lemma, whether a sentence has a verb, a text's sentences. Columns, of built-in functions or an Arrow UDF (not inside an array function then; see functions.annotate).
Lemma = Verb = Split = Callable[[Column], Column]


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def segment(text: Column) -> Column:
    """Sentences of a text by the plain rule: after . ! or ? and white space. White space collapsed, none empty; [] for null."""
    parts = F.split(F.regexp_replace(text, rf"([.!?])[{WS}]+", f"$1{_MARK}"), _MARK)
    return F.coalesce(F.filter(F.transform(parts, collapse_ws), lambda s: s != ""), F.array().cast("array<string>"))


def is_prose(sentence: Column, has_verb: Verb | None = None) -> Column:
    """Whether a sentence is prose: 3 to 65 words, mostly letters, a capital first, no reference to figures, no mathematics.

    `has_verb` takes the sentence to a boolean Column of a tagger; without one every sentence has a verb.
    """
    words, low = word_count(sentence), F.lower(sentence)
    letters = F.length(F.regexp_replace(sentence, r"[^\p{L}]", ""))
    good = words.between(3, 65) & ~any_of([low.startswith(s) for s in NO_PROSE_STARTS])
    good = good & (letters / F.greatest(F.length(sentence), F.lit(1)) >= 0.65) & ~contains_any(sentence, MATH_SIGNS)
    good = good & sentence.rlike(r"^\p{Lu}")
    return F.coalesce(good & (has_verb(sentence) if has_verb else F.lit(True)), F.lit(False))


def prose_sentences(text: Column, has_verb: Verb | None = None, split: Split = segment) -> Column:
    """The prose sentences of a text, in order. `split` takes a text to its sentences."""
    return F.filter(split(text), lambda s: is_prose(s, has_verb))


def is_acknowledgement(sentence: Column) -> Column:
    return contains_any(F.lower(sentence), ACKNOWLEDGEMENTS)


def has_cue(sentence: Column) -> Column:
    return contains_any(F.lower(sentence), CUES)


def is_header_noise(text: Column, page: Column, title: Column) -> Column:
    """Addresses, affiliations or the paper's own title on a first page. Null when the text is null."""
    low = F.lower(text)
    named = F.coalesce(title, F.lit("")) != ""
    noise = F.contains(text, F.lit("@")) | contains_any(low, FIRST_PAGE_ADDRESSES) | contains_any(low, AFFILIATIONS) | (named & F.contains(low, F.lower(F.coalesce(title, F.lit("")))))
    return F.when(page > 1, F.lit(False)).otherwise(noise)


def is_reference_title(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(rf"(?<![{WORD}])(?:references?|bibliography|works cited)(?![{WORD}])"), F.lit(False))


def without_stopwords(tokens: Column, stopwords: Sequence[str] = GENERAL_STOPWORDS) -> Column:
    """Tokens whose lower case is no stop word, repeats kept."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*stopwords))


def word_tokens(text: Column) -> Column:
    """Word tokens in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]+"), F.lit(0))


def is_content(token: Column, stopwords: Sequence[str] = GENERAL_STOPWORDS) -> Column:
    """Neither a single character nor a stop word."""
    return (F.length(token) > 1) & ~token.isin(*stopwords)


def lemmas(text: Column, stopwords: Sequence[str] = GENERAL_STOPWORDS, lemma: Lemma | None = None) -> Column:
    """Lemmas of the content tokens, in lower case; without `lemma` a token is its own."""
    tokens = F.filter(word_tokens(text), lambda t: is_content(t, stopwords))
    if lemma:
        tokens = F.filter(F.transform(tokens, lambda t: F.lower(lemma(t))), lambda t: F.length(t) > 1)
    return F.coalesce(tokens, F.array().cast("array<string>"))


def is_keyword(term: Column, least: int = 3) -> Column:
    return (F.length(term) >= least) & ~term.rlike(r"^\p{N}+$") & ~F.lower(term).isin(*METADATA_TERMS) & ~F.contains(term, F.lit("@"))
