"""Rules that tell headings from other blocks, as Columns over text and spans.

A span is struct<text, font_size, font, flags>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.prose import any_of
from vellumspark.functions.stopwords import NO_HEADING_STARTS
from vellumspark.functions.text import WORD, WS, strip_ws, word_count

# Fixed value: what a numbered heading looks like.
NUMBERED = rf"^[{WS}]*([A-Z](?![{WORD}])(?:\.\p{{Nd}}+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)*|[IVX]+(?![{WORD}]))\.?[{WS}]+([^\n]+)"


def is_numbered(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBERED), F.lit(False))


def heading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, NUMBERED, 1), F.lit(""))


def heading_level(text: Column) -> Column:
    """Parts of a heading's number; null without one."""
    return F.size(F.split(heading_number(text), r"\.")).cast("bigint")


def is_bold(span: Column) -> Column:
    font = F.lower(F.coalesce(span["font"], F.lit("")))
    return F.contains(font, F.lit("bold")) | F.contains(font, F.lit("medi")) | F.contains(font, F.lit("heavy")) | (F.coalesce(span["flags"], F.lit(0)).bitwiseAND(16) != 0)


def is_blank_span(span: Column) -> Column:
    return strip_ws(F.coalesce(span["text"], F.lit(""))) == ""


def formatting(spans: Column) -> Column:
    """struct<size, bold, first_size>: largest font size, whether all spans with text are bold, size of the first of them; 0, false, 0 without text."""
    solid = F.filter(spans, lambda s: ~is_blank_span(s))
    some = F.coalesce(F.size(solid) > 0, F.lit(False))
    return F.struct(
        F.when(some, F.array_max(F.transform(spans, lambda s: s["font_size"].cast("double")))).otherwise(0.0).alias("size"),
        F.when(some, F.forall(solid, is_bold)).otherwise(F.lit(False)).alias("bold"),
        F.when(some, F.get(solid, F.lit(0))["font_size"].cast("double")).otherwise(0.0).alias("first_size"),
    )


def looks_unnumbered(text: Column, size: Column, bold: Column) -> Column:
    shape = (F.length(text) > 0) & (F.length(text) <= 120) & ~F.contains(text, F.lit("\n")) & ~is_numbered(text) & (word_count(text) <= 12)
    return F.coalesce(shape & (size >= 9.5) & (bold | (size >= 12.0)), F.lit(False))


def is_false_heading(text: Column, size: Column, first_size: Column) -> Column:
    low, words = F.lower(text), word_count(text)
    first = F.regexp_extract(F.coalesce(heading_number(text), F.lit("")), r"^\p{Nd}+", 0)
    return F.coalesce(
        (words == 0)
        | (words > 15)
        | any_of([F.contains(low, F.lit(x)) for x in ("http://", "https://", "www.", "@", "arxiv:", "arxiv preprint", "doi:")])
        | (F.length(F.regexp_replace(text, r"[^\p{Nd}]", "")) > 8)
        | any_of([text.startswith(x) for x in NO_HEADING_STARTS])
        | ((first_size > 0) & (size > 0) & (first_size < 0.9 * size))
        | (first.try_cast("double") >= 50),
        F.coalesce(words == 0, F.lit(True)),
    )
