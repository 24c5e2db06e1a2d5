"""Sentence boundaries in any of many scripts, by a finite transducer.

The rules are compiled into tables. What stands before an end mark (an abbreviation of some kind, an initial, a number, a
word) and what follows it (nothing, a small letter, a digit, a month, ...) are classes of places; RULES say of pairs of
classes what the mark is, and SYMBOL is the table made of them. Symbols that depend on quotations and bibliographies are
functions from the transducer's states to its states (NEXT), with the states in which a sentence ends (ENDS).

Runs of symbols are composed: BLOCK symbols side by side, the blocks by a prefix scan, so that the state before every
symbol comes out without reading them one after the other. The symbol that ends a text leads every state to the first
one, hence all texts of a batch are one sequence. A text of more than CHUNK_CHARS characters is cut into chunks between
two letters, which go to different tasks: each gives the function of its symbols, these are composed in order, and the
chunks are read again from the states that come out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import WS

# Abbreviations that never end a sentence before the word that they announce.
ANNOUNCING = frozenset(
    """
    dr mr mrs ms prof hr fr st sr sra srta dra mme mlle mm me rev gen col capt lt jr
    fig figs eq eqs sec secs tab tabs abb kap bd nr no nos núm num art cap pág págs vol vols pp ch chap ref refs app thm def lem prop cor
    cf vs approx ca al resp viz ibid ed eds trans proc conf syst lett tech rep univ dept assoc
    e.g i.e z.b d.h u.a p.ex p.ej c.-à-d vgl bzw usw s.o s.u
    ex ej env janv févr avr juil sept oct nov déc
    डॉ श्री د أ م
    """.split()
)
# Abbreviations of the above that end a sentence unless a number follows.
WITH_NUMBER = frozenset("no nos nr art ch ed".split())
# Abbreviations that also stand at the end of a sentence; they end it before a capital.
CLOSING = frozenset("etc a.m p.m usw u.s u.k u.n e.u ph.d inc ltd corp jr s.a co bros".split())
# Months after an ordinal with a full stop.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

CASED = r"0-9A-Za-z_À-ɏͰ-ϿЀ-ԯ"
CJK = r"々-〇぀-ヿ㐀-鿿豈-﫿"
CLOSERS = r"""(?:["”“’'»«›‹)\]】」』）》〉]|[ \xa0 ]+»)*"""
#: What may begin a symbol: one set of characters, which the search for it skips by; full stops inside numbers, names and addresses don't.
BEGINS = re.compile(rf"[\n.!?…؟۔‼⁇⁈⁉。！？｡।॥「『“《」』”》](?:(?<![\n.!?…])|(?![{CASED}]))")
GAP_RUN = re.compile(r"\n\s*\n")
MARK_RUN = re.compile(rf"[.!?…؟۔‼⁇⁈⁉]+(?![{CASED}]){CLOSERS}")
CJK_RUN = re.compile(r"""[。！？｡]+["”’」』】）》〉)\]]*""")
DANDA_RUN = re.compile(rf"[।॥]+{CLOSERS}")
THAI_BLANK = re.compile(r"[ก-๛]\s+")
KIND = {c: k for k, cs in (("mark", ".!?…؟۔‼⁇⁈⁉"), ("cjk", "。！？｡"), ("danda", "।॥"), ("open", "「『《"), ("close", "」』”》"), ("gap", "\n"), ("either", "“")) for c in cs}
HAN = re.compile(rf"[{CJK}]")
SPACE = re.compile(r"\s*")
NAME = re.compile(r"\w{0,12}")  # longer than any month
DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
BETWEEN_LETTERS = re.compile(r"[^\W\d_](?=[^\W\d_])")
PARTICLE = re.compile(r"[とっはがをにのでもへや]|など")
SPOKEN = re.compile(r"[他她它你我您们这那]{1,3}.{0,4}[说問问道答喊想写叫]|.{0,4}[说问道答]道?[：，。]")
ENTRY = re.compile(r"(?:\[\d+\]\s*|\d{1,3}\.\s+)?(?:(?:[A-ZÀ-Þ]\.[ \xa0-]?){1,4}\s*[A-ZÀ-Þ]\w+|[A-ZÀ-Þ][\w'’-]+,\s+(?:[A-ZÀ-Þ]\.[ -]?)+)")
ENTRY_HINT = re.compile(r"\b(?:pp|vol|no|Proc|Lett|rep|al|Trans|Conf|eds?)\.")
ENTRY_END = re.compile(r"\b(?:1[89]|20)\d\d[a-z]?\)?\.\s*\Z")
PARAGRAPH = re.compile(r"(?:(?!\n\s*\n)[\s\S])+")

# states
OUT, TOLD, BARE, LISTED = range(4)  # outside; in a quote after a colon or comma; in another quote; in a bibliography entry
# symbols
END, GAP, PLAIN, QUOTED_PARTICLE, QUOTED_SPOKEN, QUOTED_FREE, SURE, BLANK, OPEN_TOLD, OPEN_BARE, CLOSE, ENTRY_BEGINS, ENTRY_ENDS = range(13)
#: NEXT[symbol][state]
NEXT = np.array(
    [
        [OUT, OUT, OUT, OUT],
        [OUT, OUT, OUT, OUT],
        [OUT, TOLD, BARE, LISTED],
        [OUT, OUT, OUT, LISTED],
        [OUT, OUT, OUT, LISTED],
        [OUT, OUT, OUT, LISTED],
        [OUT, OUT, OUT, LISTED],
        [OUT, OUT, OUT, LISTED],
        [TOLD, TOLD, BARE, LISTED],
        [BARE, TOLD, BARE, LISTED],
        [OUT, OUT, OUT, LISTED],
        [LISTED, LISTED, LISTED, LISTED],
        [OUT, OUT, OUT, LISTED],
    ],
    dtype=np.uint8,
)
#: ENDS[symbol][state]: whether a sentence ends at the symbol
ENDS = np.array(
    [
        [1, 1, 1, 1],
        [1, 1, 1, 1],
        [1, 0, 0, 0],
        [0, 0, 0, 0],
        [0, 1, 0, 0],
        [1, 1, 1, 0],
        [1, 1, 1, 0],
        [1, 1, 1, 0],
        [0, 0, 0, 0],
        [0, 0, 0, 0],
        [0, 0, 0, 0],
        [0, 0, 0, 0],
        [0, 0, 0, 1],
    ],
    dtype=bool,
)
BLOCK = 128
#: Characters of a text that one task reads.
CHUNK_CHARS = 1_000_000
#: Longer paragraphs are no bibliography entries; what a chunk sees of its neighbours.
ENTRY_CHARS = 100_000

# classes of what stands before a single full stop, and of other marks
WORD, CLOSES, WITH_NO, WITH_ED, WITH_OTHER, ANNOUNCES, INITIAL, DAY, ITEM, BANG, MARKS = range(11)
# classes of what follows
NOTHING, TIGHT, TIGHT_HAN, TIGHT_UPPER, LOWER, JOINER, ASIDE, DIGIT, MONTH, UPPER, OTHER = range(11)
ANY = range(11)
BEFORE = {w: ANNOUNCES for w in ANNOUNCING} | {w: WITH_OTHER for w in WITH_NUMBER} | {"no": WITH_NO, "ed": WITH_ED} | {w: CLOSES for w in CLOSING}
#: (before, after, symbol), the first that fits holds; NONE ends nothing in any state.
NONE = 255
RULES = (
    (ANY, [NOTHING], SURE),
    ([BANG], [TIGHT_HAN], PLAIN),
    (ANY, [TIGHT, TIGHT_HAN, LOWER, JOINER, ASIDE], NONE),
    ([CLOSES, WITH_NO, WITH_ED, WITH_OTHER], [DIGIT], NONE),
    ([WITH_OTHER], [UPPER, MONTH, TIGHT_UPPER], NONE),
    ([ANNOUNCES, INITIAL, ITEM], ANY, NONE),
    ([DAY], [MONTH], NONE),
    (ANY, ANY, SURE),
)


def compiled(rules: Sequence[tuple] = RULES) -> list[list[int]]:
    """SYMBOL[before][after]."""
    table = [[-1] * len(ANY) for _ in ANY]
    for before, after, symbol in rules:
        for b in before:
            for a in after:
                if table[b][a] < 0:
                    table[b][a] = symbol
    return table


SYMBOL = compiled()


def functions_before(symbols: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and each state at the beginning the state before the symbol; and the function of all symbols. Composed in blocks, with a prefix scan over the blocks."""
    n = len(symbols)
    block = max(1, min(block, math.isqrt(n)))
    rows = -(-n // block)
    maps = np.broadcast_to(np.arange(4, dtype=np.uint8), (rows * block, 4)).copy()
    maps[:n] = NEXT[symbols]
    maps = maps.reshape(rows, block, 4)
    for i in range(1, block):  # all blocks at once: maps[:, i] becomes the function of the block's first i + 1 symbols
        maps[:, i] = np.take_along_axis(maps[:, i], maps[:, i - 1], axis=1)
    whole, step = maps[:, -1].copy(), 1
    while step < rows:  # inclusive prefix scan over the blocks' functions
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        step *= 2
    entry = np.concatenate([np.arange(4, dtype=np.uint8)[None], whole[:-1]])
    after = np.take_along_axis(maps, np.broadcast_to(entry[:, None], (rows, block, 4)).astype(np.intp), axis=2)
    return np.concatenate([entry[:, None], after[:, :-1]], axis=1).reshape(-1, 4)[:n], whole[-1]


def states_before(symbols: np.ndarray, block: int = BLOCK, entry: int = OUT) -> np.ndarray:
    """The state before each symbol, from `entry`."""
    return functions_before(symbols, block)[0][:, entry]


def _word_before(text: str, i: int) -> str:
    """The word that ends at i; of one longer than any in the tables its end."""
    part = text[max(0, i - 24) : i]
    return part[max(part.rfind(c) for c in " \n\t\xa0([\"“„«'") + 1 :]


def _opens_paragraph(text: str, i: int) -> bool:
    """Whether nothing but white space, or a blank line, comes before i."""
    lines = 0
    while i and lines < 2 and text[i - 1].isspace():
        i -= 1
        lines += text[i] == "\n"
    return not i or lines > 1


def _before(text: str, at: int, marks: str, stop: str, gap: tuple[int, int]) -> int:
    if stop not in (".", "۔") or len(marks) > 1:
        return BANG if stop[0] in "!?" else MARKS
    word = _word_before(text, at)
    low = word.lower()
    known = BEFORE.get(low)
    if known == CLOSES or (len(low) > 2 and known != ANNOUNCES and DOTTED.fullmatch(low)):
        return CLOSES
    if known is not None:
        return known
    if len(word) == 1 and word.isalpha() and not HAN.match(word):
        return INITIAL
    if word.isdigit():
        if len(word) <= 3 and text.find("\n", *gap) < 0 and _opens_paragraph(text, at - len(word)):
            return ITEM
        return DAY if len(word) <= 2 else WORD
    return WORD


def _after(text: str, at: int, end: int, j: int, closed: bool) -> int:
    if j == len(text):
        return NOTHING
    c = text[j]
    if j == end:
        return TIGHT_UPPER if closed and c.isupper() else TIGHT_HAN if HAN.match(c) and at and HAN.match(text[at - 1]) else TIGHT
    if c.islower():
        return LOWER
    if c in ",;:–—-/|=+*.%" and text.find("\n", end, j) < 0:
        return JOINER
    if c == "(" and not (j + 1 < len(text) and (text[j + 1].isupper() or text[j + 1] in "\"“„«")):
        return ASIDE
    if c.isdigit():
        return DIGIT
    if NAME.match(text, j).group().lower() in MONTHS:
        return MONTH
    return UPPER if c.isupper() else OTHER


def _mark(text: str, at: int, marks: str, end: int) -> int:
    """The symbol of an end mark that isn't CJK."""
    j = SPACE.match(text, end).end()
    stop = marks.rstrip("\"”“’'»«›‹)]】」』）》〉 \xa0 ")
    after = _after(text, at, end, j, len(marks) > len(stop) and ")" in marks)
    return SYMBOL[_before(text, at, marks, stop, (end, j))][after]


def _entries(text: str) -> list[tuple[int, int, int]]:
    """(position, symbol, end) for the bibliography entries of a text."""
    found = []
    for p in PARAGRAPH.finditer(text):
        part = p.group()
        if len(part) > ENTRY_CHARS:
            continue
        lead = len(part) - len(part.lstrip())
        if ENTRY.match(part, lead) and ENTRY_HINT.search(part) and ENTRY_END.search(part):
            found.append((p.start() + lead, ENTRY_BEGINS, p.start() + lead))
            found += [(p.start() + m.start(), ENTRY_ENDS, p.start() + m.start() + 1) for m in re.finditer(r"\.(?=[ \t]*\n)", part) if ENTRY.match(part, SPACE.match(part, m.end()).end())]
    return found


def symbols_of(text: str, start: int = 0, stop: int | None = None) -> list[tuple[int, int, int]]:
    """(position, symbol, end of the sentence if one ends here) of text[start:stop], in order; END last if that is the text's end. The rest of the text is looked at alone."""
    out: list[tuple[int, int, int]] = []
    done, last = 0, stop is None
    stop = len(text) if last else stop
    for b in BEGINS.finditer(text, start):
        at = b.start()
        if at < done:
            continue
        if at >= stop:
            break
        kind = KIND[text[at]]
        if kind == "mark":
            m = MARK_RUN.match(text, at)
            if m:
                done = m.end()
                symbol = _mark(text, at, m.group(), done)
                if symbol != NONE:
                    out.append((at, symbol, done))
        elif kind == "gap":
            m = GAP_RUN.match(text, at)
            if m:
                done = m.end()
                out.append((at, GAP, at))
        elif kind == "danda":
            done = DANDA_RUN.match(text, at).end()
            out.append((at, SURE, done))
        elif kind == "cjk":
            done = CJK_RUN.match(text, at).end()
            if text[done - 1] in "。！？｡":
                out.append((at, PLAIN, done))
            elif PARTICLE.match(text, done):
                out.append((at, QUOTED_PARTICLE, done))
            else:
                out.append((at, QUOTED_SPOKEN if SPOKEN.match(text, done) else QUOTED_FREE, done))
        elif kind == "close":
            out.append((at, CLOSE, at + 1))
        elif HAN.match(text, at + 1):
            before = text[max(0, at - 3) : at].rstrip()
            out.append((at, OPEN_TOLD if before[-1:] in ("：", ":", "，", ",") else OPEN_BARE, at))
    thai = [(m.start(), GAP if m.group().count("\n") > 1 else BLANK, m.start() + 1) for m in THAI_BLANK.finditer(text, start, stop)]
    if thai:
        out = sorted(out + thai)
    if ENTRY_HINT.search(text):
        more = [x for x in _entries(text) if start <= x[0] < stop]
        if more:
            out = sorted(out + more, key=lambda x: (x[0], x[1] != ENTRY_BEGINS))
    if last:
        out.append((len(text), END, len(text)))
    return out


def sentence_ends(texts: Sequence[str | None]) -> list[list[int]]:
    """For each text the numbers of characters up to and including the last one of each sentence; none for null and blank texts."""
    return _ends(texts, [symbols_of(t) if t and not t.isspace() else [] for t in texts])


def _ends(texts: Sequence[str | None], marked: Sequence[list[tuple[int, int, int]]], entry: int = OUT) -> list[list[int]]:
    """The ends of sentences among the symbols of each text; all texts are one sequence, which begins in the state `entry`."""
    rows = [row for row, own in enumerate(marked) for _ in own]
    symbols = np.array([x[1] for own in marked for x in own], dtype=np.intp)
    ends = [x[2] for own in marked for x in own]
    found: list[list[int]] = [[] for _ in texts]
    for i in np.flatnonzero(ENDS[symbols, states_before(symbols, entry=entry)]) if len(symbols) else ():
        text, own, end = texts[rows[i]], found[rows[i]], ends[i]
        while end and text[end - 1].isspace():
            end -= 1
        if end > (own[-1] if own else 0):
            own.append(end)
    return [_solid(text, own) for text, own in zip(texts, found, strict=True)]


def chunk_places(text: str, size: int, margin: int = ENTRY_CHARS) -> list[tuple[int, int, int, int]]:
    """(low, start, stop, high) of chunks of about `size` characters, cut between two letters, where nothing ends; text[low:high] is what a chunk has to see."""
    cuts, at = [0], size
    while at < len(text) and (m := BETWEEN_LETTERS.search(text, at)):
        cuts.append(m.start() + 1)
        at = cuts[-1] + size
    return [(max(0, a - margin), a, b, min(len(text), b + margin)) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def chunk_function(piece: str, start: int, stop: int | None) -> list[int]:
    """The state after piece[start:stop] for each state before it."""
    symbols = np.array([x[1] for x in symbols_of(piece, start, stop)], dtype=np.intp)
    return functions_before(symbols)[1].tolist() if len(symbols) else list(range(4))


def chunk_ends(piece: str, start: int, stop: int | None, entry: int) -> list[int]:
    """The ends of sentences in piece[start:stop] from the state `entry`, counted from the piece's beginning."""
    return [e for e in _ends([piece], [symbols_of(piece, start, stop)], entry)[0] if e > start]


def _solid(text: str | None, ends: list[int]) -> list[int]:
    """Without ends that have nothing but white space since the one before."""
    out, last = [], 0
    for e in ends:
        if not text[last:e].isspace():
            out.append(e)
            last = e
    return out


def ends_column(text: Column) -> Column:
    """The ends of the sentences of a text as an array of bigint."""

    @F.arrow_udf("array<bigint>")
    def ends(column: pa.Array) -> pa.Array:
        return pa.array(sentence_ends(column.to_pylist()), pa.list_(pa.int64()))

    return ends(text)


PLACES = "array<struct<n:int,low:int,start:int,stop:int,high:int>>"


def _long_ends(rows: DataFrame, keys: Sequence[str], chunk_chars: int) -> DataFrame:
    """keys, _text, _ends of long texts, each chunk in a row of its own."""

    @F.arrow_udf(PLACES)
    def places(column: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("n", "low", "start", "stop", "high"), (i, *p), strict=True)) for i, p in enumerate(chunk_places(t, chunk_chars))] for t in column.to_pylist()], pa.list_(pa.struct([(x, pa.int32()) for x in ("n", "low", "start", "stop", "high")])))

    def each(work):
        def run(*columns: pa.Array) -> Iterator:
            return [work(*values) for values in zip(*(c.to_pylist() for c in columns), strict=True)]

        return run

    # the last chunk alone ends its text; a chunk that sees nothing before itself must not take its start for the text's
    own = lambda piece, low, start, stop, last: (piece, start - low, None if last else stop - low)

    @F.arrow_udf("array<int>")
    def function(piece: pa.Array, low: pa.Array, start: pa.Array, stop: pa.Array, last: pa.Array) -> pa.Array:
        return pa.array(each(lambda *x: chunk_function(*own(*x)))(piece, low, start, stop, last), pa.list_(pa.int32()))

    @F.arrow_udf("array<bigint>")
    def ends(piece: pa.Array, low: pa.Array, start: pa.Array, stop: pa.Array, last: pa.Array, entry: pa.Array) -> pa.Array:
        return pa.array(each(lambda *x: [x[1] + e for e in chunk_ends(*own(*x[:5]), x[5])])(piece, low, start, stop, last, entry), pa.list_(pa.int64()))

    # equal rows have equal chunks; they are told apart again by their number at the end
    named = rows.withColumn("_h", F.md5(F.concat(F.to_json(F.struct(*keys)) if keys else F.lit(""), F.lit("\n"), F.col("_text")).cast("binary")))
    placed = named.withColumn("_places", places("_text")).select("_h", "_text", F.size("_places").alias("_of"), F.explode("_places").alias("_p"))
    piece = F.expr("substring(_text, _p.low + 1, _p.high - _p.low)")
    pieces = placed.select("_h", "_p.n", piece.alias("piece"), "_p.low", "_p.start", "_p.stop", (F.col("_p.n") == F.col("_of") - 1).alias("last")).repartition("_h", "n")
    parts = pieces.select("_h", "n", function("piece", "low", "start", "stop", "last").alias("f")).groupBy("_h").agg(F.array_sort(F.collect_set(F.struct("n", "f"))).alias("_fs"))
    # the state before each chunk: functions composed in order, four numbers a chunk
    states = F.aggregate("_fs", F.array(F.lit(OUT)), lambda s, x: F.concat(s, F.array(F.get(x["f"], F.element_at(s, -1)))))
    entries = parts.select("_h", F.posexplode(states).alias("n", "entry"))
    found = pieces.join(entries, ["_h", "n"]).select("_h", "n", ends("piece", "low", "start", "stop", "last", "entry").alias("e"))
    whole = found.groupBy("_h").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("n", "e"))), lambda x: x["e"])).alias("_ends"))
    return named.join(whole, "_h").select(*keys, "_text", "_ends")


def sentence_bounds(df: DataFrame, keys: Sequence[str], text: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """keys, n, start_char, end_char: one row for each sentence of each row of `df`.

    start_char and end_char count characters (code points): the sentence is text[start_char:end_char], n counts from 0.
    Null, empty and blank texts have no sentences; repeated rows give repeated sentences; other columns are ignored.
    Texts of more than `chunk_chars` characters are read in chunks, by as many tasks; the sentences are the same.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    short = rows.where(F.length("_text") <= chunk_chars).select(*keys, "_text", ends_column(F.col("_text")).alias("_ends"))
    ends = short.unionByName(_long_ends(rows.where(F.length("_text") > chunk_chars), keys, chunk_chars))
    out = ends.select(*keys, "_text", "_ends", F.posexplode("_ends").alias("n", "end_char"))
    before = F.when(F.col("n") == 0, F.lit(0).cast("bigint")).otherwise(F.get("_ends", F.col("n") - 1))
    blank = F.length(F.regexp_extract(F.expr("substring(_text, cast(_before as int) + 1)"), rf"^[{WS}]*", 0))
    return out.withColumn("_before", before).select(*keys, F.col("n").cast("bigint").alias("n"), (F.col("_before") + blank).alias("start_char"), "end_char")
