"""Annotated texts: tokens with lemma, part of speech and what they are, by rule or by a model.

A document is array<array<TOKEN>>, the sentences of a text and their tokens. The rule runs in the JVM and knows no parts of
speech; a model runs in Arrow batches and is made once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.prose import Lemma, segment
from vellumspark.functions.stopwords import GENERAL_STOPWORDS
from vellumspark.functions.text import WORD, WS, collapse_ws, strip_ws

TOKEN = "struct<text:string,lemma:string,pos:string,stop:boolean,punct:boolean,space:boolean>"
#: A model: from texts to their sentences, each a list of tokens (dicts of TOKEN's fields).
Annotator = Callable[[Sequence[str]], Sequence[Sequence[Sequence[dict]]]]
# Parts of speech that make a sentence one with a verb.
VERBS = ("VERB", "AUX")


def annotate(text: Column, stopwords: Sequence[str] = GENERAL_STOPWORDS, lemma: Lemma | None = None) -> Column:
    """By rule: sentences end after . ! ? and white space, tokens are runs of word characters and single other signs, a token is its own lemma unless told otherwise. [] for null."""
    lemma = lemma or (lambda t: t)

    def token(t: Column) -> Column:
        punct = ~t.rlike(f"[{WORD}]")
        return F.struct(t.alias("text"), lemma(t).alias("lemma"), F.when(punct, F.lit("PUNCT")).otherwise(F.lit("X")).alias("pos"), F.lower(t).isin(*stopwords).alias("stop"), punct.alias("punct"), F.lit(False).alias("space"))

    return F.transform(segment(text), lambda s: F.transform(F.regexp_extract_all(s, F.lit(rf"[{WORD}]+|[^{WORD}{WS}]"), F.lit(0)), token))


def annotate_with(text: Column, make: Callable[[], Annotator]) -> Column:
    """By a model: `make` is called once in each worker. Null is an empty text."""

    @F.arrow_udf(f"array<array<{TOKEN}>>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        kind = pa.struct([("text", pa.string()), ("lemma", pa.string()), ("pos", pa.string()), ("stop", pa.bool_()), ("punct", pa.bool_()), ("space", pa.bool_())])
        for column in columns:
            yield pa.array([[list(s) for s in d] for d in model([t or "" for t in column.to_pylist()])], pa.list_(pa.list_(kind)))

    return run(text)


def without_stops(tokens: Column) -> Column:
    """Tokens that are no stop words; punctuation stays."""
    return F.filter(tokens, lambda t: ~t["stop"])


def token_lemmas(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["lemma"])


def clean_lemmas(tokens: Column) -> Column:
    """Lemmas in lower case, without stop words, punctuation, white space and single characters."""
    kept = F.filter(tokens, lambda t: ~t["stop"] & ~t["punct"] & ~t["space"])
    return F.filter(F.transform(kept, lambda t: F.lower(t["lemma"])), lambda x: F.length(strip_ws(x)) > 1)


def has_verb(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t["pos"].isin(*VERBS))


def sentence_text(tokens: Column) -> Column:
    """A sentence's tokens with blanks between them."""
    return collapse_ws(F.array_join(token_lemmas(F.transform(tokens, lambda t: t.withField("lemma", t["text"]))), " "))
