"""Held-out passages inside training documents: size-partitioned MinHash containment, verified by exact shingles.

What an item has to have in common with a document is a passage: `window` words, or the whole item if it is shorter. A
passage is a set of word shingles, and items fall into partitions by the size of their passages. In the partition of size
s a document is the family of its own passages of s words, so both sides of a comparison have the same number of shingles:
containment of one in the other is then a Jaccard similarity of 1, at which a single MinHash (the least shingle hash)
agrees for certain. No document is missed however long it is; a signature of the whole document would need a similarity
of one in thousands to find ten words in it. Passages that agree are compared word by word.

Before anything is shuffled, documents' passages are held against a table of FILTER_BITS bits that the items' signatures
are marked in. More items fill more of it, and it lets more pass; the result is the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.tables import written

SHINGLE, WINDOW = 5, 10
#: Bits of the table of signatures that goes to every task: 16 MB at most, less for few items.
FILTER_BITS = 1 << 27
KNOWN_WORDS = 500_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, without case and accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).casefold()) if unicodedata.category(c) != "Mn")
    else:
        text = text.lower()
    return WORD.findall(text)


class _Hasher:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def windows(self, words: Sequence[str], shingle: int, window: int) -> np.ndarray:
        """The MinHash of each window of words."""
        if len(words) < window:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        codes = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            codes[i] = h
        n = len(words) - shingle + 1
        mixed = np.zeros(n, np.uint64)
        for j in range(shingle):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        least = mixed[: n - (window - shingle)].copy()
        for j in range(1, window - shingle + 1):
            np.minimum(least, mixed[j : j + len(least)], out=least)
        return least


class _Filter:
    """The bits of the items' signatures: places and values of the words that aren't zero."""

    def __init__(self, places: np.ndarray, values: np.ndarray, bits: int):
        self.places, self.values, self.bits = places, values, bits

    def opened(self) -> np.ndarray:
        table = np.zeros(self.bits >> 6, np.uint64)
        table[self.places] = self.values.view(np.uint64)
        return table


def _passing(table: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    at = signatures & np.uint64((len(table) << 6) - 1)
    return np.flatnonzero((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))


def _passages(shingle: int, window: int, sizes: Sequence[int] | None, marked, id_type: pa.DataType):
    """id, size, signature, gram of the passages of each text: of all `sizes`, as far as `marked` lets them pass, or (None) of the text's own size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = _Hasher(), marked.value.opened() if marked is not None else None
        for batch in batches:
            ids, of, signatures, grams = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text) if text else ()
                for size in ([min(len(words), window)] if sizes is None else sizes) if words else ():
                    least = hasher.windows(words, min(shingle, size), size) ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)
                    at = range(len(least)) if table is None else _passing(table, least)
                    for gram, signature in {" ".join(words[i : i + size]): least[i] for i in at}.items():
                        ids.append(key)
                        of.append(size)
                        signatures.append(int(signature) - (1 << 63))
                        grams.append(gram)
            yield pa.record_batch([pa.array(ids, id_type), pa.array(of, pa.int32()), pa.array(signatures, pa.int64()), pa.array(grams, pa.string())], names=["id", "size", "signature", "gram"])

    return run


def leaked_items(corpus: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, shingle: int = SHINGLE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, item_id, size, windows, contained: each document that holds at least `window` consecutive words of an item, or all of a shorter one, and the items it holds.

    size is the number of words that had to be common, windows how many different passages of the item the document
    holds, contained their share of all different passages of the item. Words are runs of letters and digits; case, accents and
    whatever stands between words don't matter. Null texts and texts without words match nothing; repeated rows count
    once; the two tables' columns may bear the same names. `filter_bits` is a power of two.
    """
    context = corpus.sparkSession.sparkContext
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kind = dict(corpus.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = "id {0}, size int, signature long, gram string"
    held = written(items.select(item_id, item_text).mapInArrow(_passages(shingle, window, None, None, types[kind[1]]), schema.format(kind[1])).distinct())
    sizes = sorted(r[0] for r in held.select("size").distinct().collect())  # at most `window`
    # marks are set in the order of unsigned signatures, of which these are all but the sign
    place = f"(signature & {filter_bits - 1}L)"
    marks = held.groupBy(F.expr(f"shiftright({place}, 6)").alias("p")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 as int)))").alias("v")).toArrow()
    marked = context.broadcast(_Filter(marks.column("p").to_numpy(), marks.column("v").to_numpy(), filter_bits))
    found = corpus.select(doc_id, doc_text).mapInArrow(_passages(shingle, window, sizes, marked, types[kind[0]]), schema.format(kind[0]))
    own = held.select(F.col("id").alias("_item"), "size", "signature", "gram")
    pairs = found.select(F.col("id").alias("_doc"), "signature", "gram").join(own, ["signature", "gram"])
    hits = pairs.groupBy("_doc", "_item", "size").agg(F.countDistinct("gram").alias("windows"))
    whole = held.groupBy(F.col("id").alias("_item"), "size").agg(F.countDistinct("gram").alias("_all"))
    return hits.join(whole, ["_item", "size"]).select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id), "size", "windows", (F.col("windows") / F.col("_all")).alias("contained"))
