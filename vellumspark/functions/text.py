"""Text rules as Column expressions that run inside the JVM.

The classes are spelled out so that the rules mean the same for every script: a word character is a letter, a number or
the underscore of any script, and white space includes the no-break blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
WORD = r"\p{L}\p{N}_"
WS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"

# The patterns of the cleaning and tokenising rules.
HYPHENATED = rf"([{WORD}])-[{WS}]*\n[{WS}]*([{WORD}]+)"
CITATION = rf"\[\p{{Nd}}+(?:[,{WS}–-]+\p{{Nd}}+)*\]"
LINK = rf"https?://[^{WS}]+|www\.[^{WS}]+"
MAIL = rf"{EDGE}[{WORD}.-]+@[{WORD}.-]+\.[{WORD}]+{EDGE}"
TERM = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"


def strip_ws(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def collapse_ws(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, rf"[{WS}]+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case with collapsed white space."""
    return collapse_ws(F.lower(text))


def strip_noise(text: Column) -> Column:
    """Cleaning without the final collapsing of white space.

    Each pattern runs only over texts that hold a literal it cannot do without; the conditions look at the text as it
    came, so that the branches nest without evaluating anything twice.
    """
    has = lambda literal: F.contains(text, F.lit(literal))
    broken = has("-") & has("\n")
    steps = ((broken, HYPHENATED, "$1$2"), (has("["), CITATION, ""), (has("http") | has("www.") | broken, LINK, ""), (has("@"), MAIL, ""))
    out = text
    for needed, pattern, to in steps:
        out = F.when(needed, F.regexp_replace(out, pattern, to)).otherwise(out)
    return out


def clean_text(text: Column) -> Column:
    """Rejoins words hyphenated at line ends, drops bracketed citation numbers, links and mail addresses, collapses white space."""
    return collapse_ws(strip_noise(text))


def tokenize(text: Column) -> Column:
    """Word tokens in their own case; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"[{WORD}]+"), F.lit(0)), F.array().cast("array<string>"))


def preprocess(text: Column) -> Column:
    """Tokens of the normalised text."""
    return tokenize(normalize_text(text))


def search_terms(text: Column) -> Column:
    """Lower-case terms of ASCII letters and digits, joined by single - _ or . signs; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def clean_terms(text: Column) -> Column:
    """search_terms of clean_text."""
    return search_terms(strip_noise(text))


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null and blank."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(rf"[^{WS}]+"), F.lit(0))), F.lit(0)).cast("bigint")


def token_estimate(text: Column) -> Column:
    """Tokens estimated from words: 0 without words, else the whole part of 1.3 times the words, at least 1."""
    words = word_count(text)
    return F.when(words == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor(words * F.lit(1.3)).cast("bigint")))
