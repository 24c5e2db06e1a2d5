"""Titles, dates, identifiers and names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.headings import is_bold
from vellumspark.functions.prose import any_of
from vellumspark.functions.stopwords import INSTITUTIONS, MONTHS
from vellumspark.functions.text import WORD, WS, collapse_ws, strip_ws

_START, _STOP = rf"(?<![{WORD}])", rf"(?![{WORD}])"
# Patterns of years, days, identifiers and dates.
YEAR = rf"{_START}(20\p{{Nd}}{{2}}|19\p{{Nd}}{{2}}){_STOP}"
DAY = rf"{_START}([1-9]|[12]\p{{Nd}}|3[01]){_STOP}"
DOI = rf"{_START}(10\.\p{{Nd}}{{4,9}}/[-._;()/:a-zA-Z0-9]+){_STOP}"
ARXIV = r"(?i)arxiv:(\p{Nd}{4}\.\p{Nd}{4,5})"
WATERMARK = rf"(?i)\[cs\.[a-z]+\][{WS}]+(\p{{Nd}}{{1,2}}[{WS}]+[a-z]+[{WS}]+\p{{Nd}}{{4}})"
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = (
    rf"(?i)({_START}\p{{Nd}}{{1,2}}[{WS}]+(?:{_LONG})[{WS}]+\p{{Nd}}{{4}}{_STOP}"
    rf"|{_START}(?:{_LONG})[{WS}]+\p{{Nd}}{{1,2}},?[{WS}]+\p{{Nd}}{{4}}{_STOP}"
    rf"|{_START}\p{{Nd}}{{1,2}}[{WS}]+(?:{_SHORT})[a-z]*[{WS}]+\p{{Nd}}{{4}}{_STOP})"
)
CONFERENCE = rf"(?i){_START}(?:nips|neurips)[{WS}]+(\p{{Nd}}{{4}}){_STOP}"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null for a date that doesn't exist."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def clean_title(title: Column) -> Column:
    return collapse_ws(F.regexp_replace(F.lower(title), rf"[^a-z0-9{WS}]", ""))


def title_words(title: Column) -> Column:
    return F.filter(F.array_distinct(F.split(clean_title(title), " ")), lambda w: w != "")


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the titles' words; 0 if either has none."""
    x, y = title_words(a), title_words(b)
    empty = (F.coalesce(F.size(x), F.lit(0)) <= 0) | (F.coalesce(F.size(y), F.lit(0)) <= 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def parse_date(text: Column) -> Column:
    """ISO date, else month name and year with the day if one is told, else 1 December of the year, else null."""
    iso = r"(\p{Nd}{4})-(\p{Nd}{2})-(\p{Nd}{2})"
    year = _found(text, YEAR)
    day = F.coalesce(_found(F.replace(text, year, F.lit("")), DAY), F.lit("1"))
    low, month = F.lower(text), F.lit(None).cast("string")
    for n in range(12, 0, -1):
        month = F.when(F.contains(low, F.lit(MONTHS[n - 1])), F.lit(str(n))).otherwise(month)
    return F.when(text.rlike(iso), _date(_found(text, iso, 1), _found(text, iso, 2), _found(text, iso, 3))).when(month.isNotNull() & year.isNotNull(), _date(year, month, day)).when(year.isNotNull(), _date(year, F.lit("12"), F.lit("1")))


def find_doi(text: Column) -> Column:
    return _found(text, DOI)


def find_arxiv_id(text: Column) -> Column:
    return _found(text, ARXIV)


def first_page_date(text: Column) -> Column:
    """From the watermark, else from a date in the text; else 1 December of a conference's year."""
    watermark, date = _found(text, WATERMARK), _found(text, DATE)
    local = F.when(watermark.isNotNull(), parse_date(watermark)).when(date.isNotNull(), parse_date(date))
    return F.coalesce(local, _date(_found(text, CONFERENCE), F.lit("12"), F.lit("1")))


def doi_or_arxiv(doi: Column, arxiv_id: Column) -> Column:
    return F.coalesce(doi, F.concat(F.lit("10.48550/arXiv."), arxiv_id))


def split_authors(authors: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(authors, ","), strip_ws), lambda a: a != ""), F.array().cast("array<string>"))


def paper_key(arxiv_id: Column, doi: Column, title: Column, sanitise: bool = True) -> Column:
    """arXiv id, else DOI, else the title's first 50 characters in lower case with underscores; signs become underscores unless told otherwise."""
    titled = F.substring(F.replace(F.lower(F.coalesce(F.nullif(title, F.lit("")), F.lit("paper"))), F.lit(" "), F.lit("_")), 1, 50)
    key = F.coalesce(F.nullif(arxiv_id, F.lit("")), F.nullif(doi, F.lit("")), titled)
    return F.regexp_replace(key, "[^a-zA-Z0-9_-]", "_") if sanitise else key


def author_names(spans: Column) -> Column:
    """Names among a block's bold spans: footnote signs dropped, no institution, every word that begins with a letter capitalised."""
    bare = F.transform(F.filter(spans, is_bold), lambda s: strip_ws(F.regexp_replace(strip_ws(s["text"]), r"[*†‡§¶#\p{Nd}]+\z", "")))

    def is_name(t: Column) -> Column:
        words = F.split(collapse_ws(t), " ")
        capital = F.forall(words, lambda w: ~w.rlike(r"^\p{L}") | w.rlike("^[\\p{Lu}\\p{Lt}Ł]"))
        return (F.length(t) >= 3) & ~any_of([F.contains(F.lower(t), F.lit(x)) for x in INSTITUTIONS]) & capital

    return F.filter(bare, is_name)


def flatten_metadata(metadata: Column) -> Column:
    """A map without null values; values that are lists are joined before (see join_list)."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def join_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit("None"))), ", ")
