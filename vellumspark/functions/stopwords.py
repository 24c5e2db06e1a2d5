"""Word lists that results depend on."""

from __future__ import annotations

# Stop words of the lexical search, which end in words that queries about papers begin with.
SEARCH_STOPWORDS = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below between both but by
    can did do does doing down during each few for from further had has have having he her here hers herself him himself
    his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
    ourselves out over own s same she should so some such t than that the their theirs them themselves then there these
    they this those through to too under until up very was we were what when where which while who whom why will with
    would you your yours yourself yourselves tell explain describe paper model show find
    """.split()
)

# Words of the search list that are no general stop words.
SEARCH_ONLY = tuple("having s t theirs tell explain describe paper model show find".split())
# Further general English stop words.
GENERAL_ONLY = tuple(
    """
    across afterwards almost alone along already also although always among amongst amount another anyhow anyone anything
    anyway anywhere around back became become becomes becoming beforehand behind beside besides beyond bottom ca call cannot
    could done due eight either eleven else elsewhere empty enough even ever every everyone everything everywhere except
    fifteen fifty first five former formerly forty four front full get give go hence hereafter hereby herein hereupon however
    hundred indeed keep last latter latterly least less made make many may meanwhile might mine moreover mostly move much must
    name namely neither never nevertheless next nine nobody none noone nothing nowhere often one onto others otherwise part
    per perhaps please put quite rather re really regarding say see seem seemed seeming seems serious several show side since
    six sixty somehow someone something sometime sometimes somewhere still take ten thence thereafter thereby therefore
    therein thereupon third though three throughout thru thus together top toward towards twelve twenty two unless upon us
    used using various via well whatever whence whenever whereafter whereas whereby wherein whereupon wherever whether whither
    whoever whole whose within without yet
    """.split()
)
#: Stop words of keywords, summaries and term statistics.
GENERAL_STOPWORDS = tuple(sorted({*SEARCH_STOPWORDS} - {*SEARCH_ONLY} | {*GENERAL_ONLY}))

# Terms that are no keywords.
METADATA_TERMS = tuple("arxiv preprint doi http https et al figure table fig author university google department research equal contribution email".split())

# Affiliations on a first page.
AFFILIATIONS = ("google brain", "google research", "university", "department of")
FIRST_PAGE_ADDRESSES = ("google.com", "toronto.edu")

# Parts of section titles that a summary leaves out, and those that it prefers.
EXCLUDED_SECTIONS = ("reference", "bibliography", "acknowledgement", "acknowledgment", "appendix", "appendices", "table", "figure")
SUMMARY_SECTIONS = ("abstract", "introduction", "conclusion")

# Marks of acknowledgements and of sentences that state a contribution.
ACKNOWLEDGEMENTS = ("acknowledgement", "grateful to", "thank", "supported by", "fellowship")
CUES = ("we propose", "we present", "we introduce", "in this work", "in this paper", "our model", "we show", "we find", "outperform", "state-of-the-art", "results show", "rely entirely")

# Beginnings and signs of what is no prose sentence.
NO_PROSE_STARTS = ("see ", "figure ", "table ", "fig. ", "where ", "for each ", "equation ", "eq. ")
MATH_SIGNS = ("∈", "≤", "≥", "∑", "∏", "√", "∝", "∼", "±", "×", "÷", "≠", "≡", "d_model")

# Beginnings of what is no heading.
NO_HEADING_STARTS = ("Note ", "See ", "For example,", "Figure ", "Table ", "Fig. ", "Download ", "ISBN ")

# Parts of names that are institutions.
INSTITUTIONS = ("google", "university", "department", "research", "microsoft", "school", "college", "institute", "laboratory")

# Months, in the order in which they are tried.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
