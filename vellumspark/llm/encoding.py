"""Encoding with a public byte-level BPE vocabulary by longest matches and backtracking.

The matcher knows strings, so bytes are read as Latin-1 characters. A sequence of tokens is what the merges would give
exactly if every two neighbours are what the merges would give for the two alone; so the encoder takes the longest token
that goes with the one before it, steps back where none does, remembers ends that led nowhere, and remembers which
tokens go together. The time is linear in the length, also for words of a million letters.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that divides a text before the merges.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Divided parts whose ids a worker remembers, and pairs of tokens whose fit it remembers.
KNOWN_PARTS, KNOWN_PAIRS = 300_000, 1_000_000
#: Parts longer than this are not remembered.
KNOWN_LENGTH = 40


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file is: in `folder`, else in the folder VELLUM_TOKENIZERS names, else in that of the machine."""
    return os.path.join(folder or os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers"), name)


class ByteEncoder:
    """A rank file: each line a token in base 64 and its id; ids are in the order of the merges, single bytes come first."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.ids = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.matcher = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matcher.add_word(token, i)
        self.matcher.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, i in ranks.items():
            if len(token) > 1:
                self.halves[i] = a, b = self._halves(token, i)
                self.joined[a, b] = i
        self.shorter: dict[int, int] = {}
        for token, i in ranks.items():
            self.shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.fits: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: str, rank: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one."""
        parts = list(token)
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = self.ids.get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                raise ValueError(f"token {rank} is not reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether the merges leave the two side by side: undo them from the latest on, looking for an earlier merge across the seam."""
        bound = 1 << 40
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left = left > right
            if undo_left and left not in self.halves:
                return True
            if not undo_left and right not in self.halves:
                if left not in self.halves:
                    return True
                undo_left = True
            if undo_left:
                bound, left = left, self.halves[left][1]
            else:
                bound, right = right + 1, self.halves[right][0]

    def _go_together(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= KNOWN_PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self._neighbours(left, right)
        return known

    def _longest(self, part: str) -> list[int]:
        """For every place the id of the longest token that begins there."""
        longest = [-1] * len(part)
        reach = [0] * len(part)
        for end, i in self.matcher.iter(part):
            n = len(self.text[i])
            start = end - n + 1
            if n > reach[start]:
                reach[start], longest[start] = n, i
        return longest

    def encode_part(self, part: str) -> list[int]:
        """The ids of one divided part, given as Latin-1 characters."""
        whole = self.ids.get(part)
        if whole is not None:
            return [whole]
        longest = self._longest(part)
        n, at, out = len(part), 0, []
        open_end = bytearray([1]) * (n + 1)
        token = longest[0]
        while at < n:
            end = at + len(self.text[token])
            if open_end[end] and (not out or self._go_together(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self.shorter[token]
            while token < 0:  # nothing goes on from here: this end is closed, and the token before is tried shorter
                open_end[at] = 0
                back = out.pop()
                at -= len(self.text[back])
                token = self.shorter[back]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.parts
        for part in PATTERN.findall(text):
            known = parts.get(part)
            if known is None:
                known = tuple(self.encode_part(part.encode("utf-8", "surrogatepass").decode("latin-1")))
                if len(part) <= KNOWN_LENGTH:
                    if len(parts) >= KNOWN_PARTS:
                        parts.clear()
                    parts[part] = known
            out.extend(known)
        return out


@lru_cache(maxsize=2)
def encoder_of(rank_file: bytes) -> ByteEncoder:
    return ByteEncoder(rank_file)


def encoder(path: str) -> ByteEncoder:
    with open(path, "rb") as f:
        return encoder_of(f.read())


def encode_texts(df: DataFrame, keys: Sequence[str], text: str, path: str | None = None) -> DataFrame:
    """keys, ids (array<int>): the token ids of each row's whole text, without special tokens (their names are ordinary text).

    An empty text and a null text have an empty list. Repeated rows are encoded each. The vocabulary is a file of the
    driver, of about a megabyte, which goes to the executors with the job; nothing is shuffled.
    """
    with open(path or vocabulary_path(), "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = encoder_of(shipped.value)
        for column in batches:
            yield pa.array([known.encode(t) if t else [] for t in column.to_pylist()], pa.list_(pa.int32()))

    return df.select(*keys, ids(F.col(text)).alias("ids"))
