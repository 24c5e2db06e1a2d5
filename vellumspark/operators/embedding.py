"""Pluggable text embedding: any function from texts to vectors, run in Arrow batches; a hashing one by default."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import clean_text, word_count

Embedder = Callable[[Sequence[str]], np.ndarray]


@lru_cache(maxsize=200_000)
def _place(word: str) -> tuple[int, float]:
    code = zlib.crc32(word.encode())
    return code >> 1, 1.0 if code & 1 else -1.0


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Signed feature hashing of words, unit length; no words give zeros. The same on every machine."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                at, sign = _place(w)
                out[i, at % dimensions] += sign
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return embed


def embed(text: Column, make: Callable[[], Embedder] = hashing_embedder, batch: int = 32) -> Column:
    """Vectors (array<float>) of cleaned texts. `make` is called once in each worker, which loads a model only there. Null and empty texts give zeros."""

    @F.arrow_udf("array<float>")
    def vectors(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            parts = [np.asarray(model(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            yield pa.array([list(map(float, r)) for p in parts for r in p], pa.list_(pa.float32()))

    return vectors(clean_text(F.coalesce(text, F.lit(""))))


def embed_blocks(blocks: DataFrame, sections: DataFrame, least_words: int = 5, make: Callable[[], Embedder] = hashing_embedder) -> DataFrame:
    """Blocks of any type with at least `least_words` words, their section's title and their vector."""
    titled = sections.select("doc_id", "section_id", F.col("title").alias("section_title"))
    rows = blocks.where(word_count(clean_text(F.col("text"))) >= least_words).join(titled, ["doc_id", "section_id"], "left")
    return rows.withColumn("embedding", embed(F.col("text"), make))
