"""Cutting oversized texts at natural boundaries, by packing a tree of their structure."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import token_estimate
from vellumspark.llm.sentences import sentence_ends

PIECE = "array<struct<start_char:bigint,new_char:bigint,end_char:bigint>>"
WORD_RUN = re.compile(r"\S+")
BLANK_LINE = re.compile(r"\n\s*\n")
LIST_ITEM = re.compile(r"^[ \t]*(?:[-*•‣◦]|\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})[.)])[ \t]+", re.M)
CLAUSE = re.compile(r"[,;:，；：、|/](?:\s+|(?=\S))")
HEADING = re.compile(r"^(?:(?P<hash>#{1,6})[ \t]+\S.*|(?P<number>\d+(?:\.\d+)*|[IVX]+(?:\.\d+)*)\.?[ \t]+[^\n.!?]{2,80}|(?P<caps>[A-Z][A-Z0-9 ,&-]{2,80}))$", re.M)

# levels of the tree below headings
PARAGRAPHS, ITEMS, SENTENCES, CLAUSES, WORDS, CHARACTERS = range(6)


@dataclass(frozen=True)
class Limits:
    """tokens are 1.3 times the words between white space, rounded down; a piece keeps both limits, overlap included."""

    tokens: int = 300
    chars: int = 2400
    overlap_tokens: int = 50

    @staticmethod
    def _words(tokens: int) -> int:
        return (10 * tokens + 9) // 13

    @property
    def words(self) -> int:
        return self._words(self.tokens)

    @property
    def overlap_words(self) -> int:
        return self._words(self.overlap_tokens)

    @property
    def overlap_chars(self) -> int:
        """For text without white space: the same share of a piece."""
        return self.chars * self.overlap_tokens // self.tokens

    @property
    def new_words(self) -> int:
        """Words that a piece adds; a word that a cut goes through counts on both sides."""
        return max(1, self.words - self.overlap_words - 1)

    @property
    def new_chars(self) -> int:
        return max(1, self.chars - self.overlap_chars)


@dataclass
class _Node:
    """A span of the text; `inner` are the headings right below it, `level` is the lowest kind of cut that may divide it."""

    start: int
    end: int
    level: int
    inner: list[_Node]


class _Text:
    """A text with the places of its words, and its structure as a tree: headings by depth, then paragraphs, list items, sentences, clauses, words, characters."""

    def __init__(self, text: str, limits: Limits):
        self.text, self.limits = text, limits
        spans = [m.span() for m in WORD_RUN.finditer(text)]
        self.starts = [a for a, _ in spans]
        self.ends = [b for _, b in spans]
        self.places: dict[int, list[int]] = {}

    def words(self, a: int, b: int) -> int:
        return max(0, bisect_left(self.starts, b) - bisect_right(self.ends, a))

    def fits(self, a: int, b: int) -> bool:
        return b - a <= self.limits.new_chars and self.words(a, b) <= self.limits.new_words

    def cuts(self, level: int) -> list[int]:
        """All places of the text where a part of that level begins, found once."""
        if level not in self.places:
            if level == PARAGRAPHS:
                found = [m.end() for m in BLANK_LINE.finditer(self.text)]
            elif level == ITEMS:
                found = [m.start() for m in LIST_ITEM.finditer(self.text)]
            elif level == SENTENCES:
                found = []
                for e in sentence_ends([self.text])[0]:
                    while e < len(self.text) and self.text[e].isspace():  # the white space after a sentence goes with it
                        e += 1
                    found.append(e)
            elif level == CLAUSES:
                found = [m.end() for m in CLAUSE.finditer(self.text)]
            else:
                found = self.starts
            self.places[level] = found
        return self.places[level]

    def tree(self) -> _Node:
        """The headings as a tree, in one pass with the open headings on a stack."""
        root = _Node(0, len(self.text), PARAGRAPHS, [])
        opened = [(0, root)]
        for m in HEADING.finditer(self.text):
            depth = len(m["hash"]) if m["hash"] else m["number"].count(".") + 1 if m["number"] else 1
            while opened[-1][0] >= depth:
                opened.pop()[1].end = m.start()
            node = _Node(m.start(), len(self.text), PARAGRAPHS, [])
            opened[-1][1].inner.append(node)
            opened.append((depth, node))
        return root

    def children(self, node: _Node) -> list[_Node]:
        """What an oversized node consists of: the text before its first inner heading and those headings, or else the parts at the highest level that divides it."""
        if node.inner:
            lead = node.inner[0].start
            return ([_Node(node.start, lead, PARAGRAPHS, [])] if lead > node.start else []) + node.inner
        level, a, b, found = node.level, node.start, node.end, []
        while level < CHARACTERS and not found:
            places = self.cuts(level)
            found = places[bisect_right(places, a) : bisect_left(places, b)]
            level += 1
        if not found:
            at = a
            while at + self.limits.new_chars < b:
                at += self.limits.new_chars
                while at > a + 1 and unicodedata.combining(self.text[at]):
                    at -= 1
                found.append(at)
            level = CHARACTERS + 1  # such parts fit, but for a run of combining marks, which is cut again
        return [_Node(x, y, min(level, CHARACTERS), []) for x, y in zip([a, *found], [*found, b], strict=True)]

    def pack(self) -> list[tuple[int, int]]:
        """The pieces: siblings that fit are merged while they do, bottom-up; only oversized nodes are opened, and what is inside them is merged with nothing outside."""
        out: list[tuple[int, int]] = []
        frames: list[tuple[Iterator[_Node], list[int]]] = [(iter([self.tree()]), [])]
        while frames:
            siblings, piece = frames[-1]
            node = next(siblings, None)
            if node is not None and self.fits(node.start, node.end):
                if piece and self.fits(piece[0], node.end):
                    piece[1] = node.end
                    continue
                if piece:
                    out.append((piece[0], piece[1]))
                piece[:] = [node.start, node.end]
                continue
            if piece:
                out.append((piece[0], piece[1]))
                piece.clear()
            if node is None:
                frames.pop()
            else:
                frames.append((iter(self.children(node)), []))
        return out

    def overlap_from(self, least: int, at: int) -> int:
        """Where the repeated end of the piece before begins: at a sentence if one of a good length does, else at a word, else at a character."""
        within = lambda c: at - c <= self.limits.overlap_chars and self.words(c, at) <= self.limits.overlap_words
        cuts = self.cuts(SENTENCES)
        for c in cuts[bisect_left(cuts, least) : bisect_left(cuts, at)]:
            if within(c):
                if 2 * self.words(c, at) >= self.limits.overlap_words or 2 * (at - c) >= self.limits.overlap_chars:
                    return c
                break
        i = bisect_left(self.starts, at)
        for c in self.starts[max(0, i - self.limits.overlap_words) : i]:
            if c >= least and within(c):
                if 2 * self.words(c, at) >= self.limits.overlap_words or 2 * (at - c) >= self.limits.overlap_chars or c == least:
                    return c
                break
        c = max(least, at - self.limits.overlap_chars)
        while c < at and self.words(c, at) > self.limits.overlap_words:
            c += 1
        while c < at and unicodedata.combining(self.text[c]):
            c += 1
        return c


def oversized(text: str, limits: Limits) -> bool:
    return len(text) > limits.chars or (len(text) > 2 * limits.words and len(text.split()) > limits.words)


def split_text(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int]]:
    """(start, new, end) of each piece: text[start:new] repeats the piece before, text[new:end] is new; the new parts tile the text."""
    if not text:
        return []
    if not oversized(text, limits):
        return [(0, 0, len(text))]
    whole = _Text(text, limits)
    out: list[tuple[int, int, int]] = []
    for a, b in whole.pack():
        start = whole.overlap_from(out[-1][1], a) if out and limits.overlap_tokens else a
        out.append((start, a, b))
    return out


def pieces_column(text: Column, limits: Limits = Limits()) -> Column:
    """split_text as an array column."""

    @F.arrow_udf(PIECE)
    def pieces(column: pa.Array) -> pa.Array:
        struct = pa.struct([("start_char", pa.int64()), ("new_char", pa.int64()), ("end_char", pa.int64())])
        cut: Callable[[str], list] = lambda t: [dict(zip(("start_char", "new_char", "end_char"), p, strict=True)) for p in split_text(t, limits)]
        return pa.array([None if t is None else cut(t) for t in column.to_pylist()], pa.list_(struct))

    return pieces(text)


def split_items(df: DataFrame, keys: Sequence[str], text: str, limits: Limits = Limits()) -> DataFrame:
    """keys, n, start_char, new_char, end_char, piece: the pieces of each row's text, n counting from 0.

    A text within the limits is one piece. Otherwise each piece keeps them and, but for the first, begins with about
    `overlap_tokens` tokens of the one before (text[start_char:new_char]); the parts text[new_char:end_char] tile the
    text. Null and empty texts have no pieces, a blank text is cut like any other; repeated rows give repeated pieces.
    """
    cut = df.select(*keys, F.col(text).alias("_text")).select(*keys, "_text", pieces_column(F.col("_text"), limits).alias("_pieces"))
    out = cut.select(*keys, "_text", F.posexplode("_pieces").alias("n", "_p"))
    piece = F.expr("substring(_text, cast(_p.start_char as int) + 1, cast(_p.end_char - _p.start_char as int))")
    return out.select(*keys, F.col("n").cast("bigint").alias("n"), "_p.start_char", "_p.new_char", "_p.end_char", piece.alias("piece"))


def pieces_hold(df: DataFrame, keys: Sequence[str], text: str, limits: Limits = Limits()) -> DataFrame:
    """keys, tiles, within, overlaps: for each row with a text that is not empty, whether the new parts of its pieces make up the text, all pieces keep the limits, and each after the first repeats some of the one before."""
    rows = df.where(F.length(text) > 0).select(*keys, F.col(text).alias("_text"), pieces_column(F.col(text), limits).alias("_p"))
    part = lambda a, b: F.substring(F.col("_text"), (a + 1).cast("int"), (b - a).cast("int"))
    tiles = F.array_join(F.transform("_p", lambda p: part(p["new_char"], p["end_char"])), "") == F.col("_text")
    within = F.forall("_p", lambda p: (p["end_char"] - p["start_char"] <= limits.chars) & (token_estimate(part(p["start_char"], p["end_char"])) <= limits.tokens))
    before = lambda i: F.get("_p", i - 1)
    repeated = F.transform("_p", lambda p, i: (i == 0) | ((p["start_char"] < p["new_char"]) & (before(i)["end_char"] == p["new_char"]) & (p["start_char"] >= before(i)["new_char"])))
    return rows.select(*keys, tiles.alias("tiles"), within.alias("within"), F.forall(repeated, lambda x: x).alias("overlaps"))
