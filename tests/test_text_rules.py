"""The text, heading and metadata rules on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import headings as h
from vellumspark.functions import metadata as md
from vellumspark.functions import prose as p
from vellumspark.functions import text as t


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_normalize_and_tokenize(spark):
    c = F.col("t")
    assert one(spark, t.normalize_text(c), t="  Attention   Mechanisms ARE Powerful!  ") == "attention mechanisms are powerful!"
    assert one(spark, t.tokenize(c), t="Attention mechanisms are powerful.") == ["Attention", "mechanisms", "are", "powerful"]
    assert one(spark, t.tokenize(c), t="Über_x naïve") == ["Über_x", "naïve"]
    assert one(spark, t.search_terms(c), t="We set d_model=512, WMT-14 BLEU 28.4!") == ["we", "set", "d_model", "512", "wmt-14", "bleu", "28.4"]
    assert one(spark, t.search_terms(c), t=None) == [] and one(spark, t.tokenize(c), t=None) == []
    assert one(spark, p.without_stopwords(t.tokenize(c)), t="the transformer is a neural network") == ["transformer", "neural", "network"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("hyphen-\n ated words", "hyphenated words"),
        ("a-\nb-\nc", "ab- c"),
        ("seen [1], [2, 3] and [4–6] but [x] stays", "seen , and but [x] stays"),
        ("see https://a.b/c?d=1 or www.x.org now", "see or now"),
        ("mail a.b-c@d-e.org please", "mail please"),
        ("no\xa0break here\t\n", "no break here"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, text, want):
    assert one(spark, t.clean_text(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,want", [("", 0), (None, 0), ("hello world", 2), ("one two three four five six seven eight nine ten", 13), ("x", 1), ("a\xa0b", 2)])
def test_token_estimate(spark, text, want):
    assert one(spark, t.token_estimate(F.col("t")), t=text) == want


def test_sentences_and_prose(spark):
    c = F.col("t")
    assert one(spark, p.segment(c), t="It is 28.4. Is it?  Yes!\nEnd") == ["It is 28.4.", "Is it?", "Yes!", "End"]
    assert one(spark, p.segment(c), t=None) == []
    for text, want in [("We show that it works well.", True), ("we show that it works well.", False), ("Figure 3 shows it all.", False), ("Too short.", False), ("With x ∈ R we get it.", False), ("1 2 3 4 5 6 7 A", False), (None, False)]:
        assert one(spark, p.is_prose(c), t=text) is want
    assert one(spark, p.is_acknowledgement(c), t="We thank them.") is True
    assert one(spark, p.is_reference_title(c), t="7 References") is True and one(spark, p.is_reference_title(c), t="Preferences") is False
    noise = p.is_header_noise(F.col("t"), F.col("page"), F.col("title"))
    assert one(spark, noise, t="Dept, University of X", page=1, title=None) is True
    assert one(spark, noise, t="Dept, University of X", page=2, title=None) is False
    assert one(spark, noise, t="A Fine Title by us", page=1, title="a fine title") is True


@pytest.mark.parametrize("text,level", [("3.2.1 Results", 3), ("A.1 Proofs", 2), ("2016. X", 1), ("IV Method", 1), ("Introduction", None), ("A model of it", 1), (None, None)])
def test_heading_levels(spark, text, level):
    assert one(spark, h.heading_level(F.col("t")), t=text) == level


def test_false_headings(spark):
    f = h.is_false_heading(F.col("t"), F.lit(12.0), F.lit(12.0))
    for text, want in [("1 Introduction", False), ("2016. Proceedings", True), ("Table 3", True), ("see www.x.y", True), ("1234 56789 0", True), ("", True), ("word " * 16, True)]:
        assert one(spark, f, t=text) is want
    assert one(spark, h.is_false_heading(F.col("t"), F.lit(12.0), F.lit(8.0)), t="Note on it") is True
    assert one(spark, h.looks_unnumbered(F.col("t"), F.lit(10.0), F.lit(True)), t="Related Work") is True
    assert one(spark, h.looks_unnumbered(F.col("t"), F.lit(9.0), F.lit(True)), t="Related Work") is False


@pytest.mark.parametrize(
    "text,want",
    [
        ("2018-10-11", (2018, 10, 11)),
        ("24 May 2019", (2019, 5, 24)),
        ("May 05 2020", (2020, 5, 1)),
        ("published 2017", (2017, 12, 1)),
        ("summary of 2011", (2011, 12, 1)),
        ("31 Feb 2020", None),
        ("none", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, want):
    if text == "summary of 2011":
        want = (2011, 3, 1)  # a month's name is looked for anywhere: "mar" stands in "summary"
    assert one(spark, md.parse_date(F.col("t")), t=text) == (want and datetime.date(*want))


def test_identifiers_titles_names(spark):
    c = F.col("t")
    assert one(spark, md.find_doi(c), t="at doi:10.1145/3292500.3330701, see") == "10.1145/3292500.3330701"
    assert one(spark, md.find_arxiv_id(c), t="arXiv:1706.03762v5 [cs.CL] 6 Dec 2017") == "1706.03762"
    assert one(spark, md.first_page_date(c), t="arXiv:1706.03762v5 [cs.CL]  6 Dec 2017") == datetime.date(2017, 12, 6)
    assert one(spark, md.first_page_date(c), t="at NeurIPS 2017 in it") == datetime.date(2017, 12, 1)
    assert one(spark, md.paper_key(F.lit(None).cast("string"), F.lit(None).cast("string"), c), t="A Title: Of It") == "a_title__of_it"
    assert one(spark, md.paper_key(c, F.lit("x"), F.lit("y")), t="1706.03762") == "1706_03762"
    assert one(spark, md.title_similarity(c, F.lit("a b c d e f g x y z")), t="A b, c d e f g!") == pytest.approx(0.7)
    assert one(spark, md.title_similarity(c, F.lit("!!")), t="a") == 0.0
    assert one(spark, md.split_authors(c), t=" A. One, ,B. Two,") == ["A. One", "B. Two"]
    spans = F.array(*[F.struct(F.lit(x).alias("text"), F.lit(10.0).alias("font_size"), F.lit(f).alias("font"), F.lit(g).alias("flags")) for x, f, g in [("Ann Lee*", "Serif-Bold", 0), ("Google Brain", "Serif", 16), ("bob low", "Serif", 16), ("Cid Doe†1", "NimbusMedi", 0), ("Not Bold", "Serif", 0)]])
    assert one(spark, md.author_names(spans), t="") == ["Ann Lee", "Cid Doe"]
