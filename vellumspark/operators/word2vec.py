"""Word vectors as a model: training by skip-gram (MLlib) or CBOW, look-ups, saving and loading.

Either way the model of a round (two vectors for each word of the vocabulary) must fit in a task, as it does in MLlib;
`min_count` bounds the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.vectors import cosine
from vellumspark.operators import pooling
from vellumspark.tables import written

NEGATIVES = 5
RATES = 0.025, 0.0001
ARCHITECTURES = ("cbow", "skip-gram")


class WordVectors:
    """word, vector, and how they were made."""

    def __init__(self, vectors: DataFrame, architecture: str = "cbow"):
        self.vectors, self.architecture_name = vectors, architecture

    @staticmethod
    def train(sentences: DataFrame, column: str = "tokens", architecture: str = "cbow", size: int = 100, window: int = 5, min_count: int = 2, epochs: int = 50, seed: int = 42, partitions: int = 1) -> WordVectors:
        """An empty table is an error."""
        if architecture not in ARCHITECTURES:
            raise ValueError(f"architecture must be one of {ARCHITECTURES}")
        if architecture == "skip-gram":
            return WordVectors(pooling.train(sentences, column, size, window, min_count, epochs, seed, partitions), architecture)
        return WordVectors(train_cbow(sentences, column, size, window, min_count, epochs, seed, partitions), architecture)

    def vocab_size(self) -> int:
        return self.vectors.count()

    def vocabulary(self) -> DataFrame:
        return self.vectors.select("word").orderBy("word")

    def has_word(self, word: str) -> bool:
        return self.vectors.where(F.col("word") == word.lower()).limit(1).count() > 0

    def get_vector(self, word: str) -> list[float]:
        row = self.vectors.where(F.col("word") == word.lower()).first()
        if row is None:
            raise KeyError(word)
        return list(row.vector)

    def similarity(self, a: str, b: str) -> float:
        """An unknown word is a KeyError."""
        one = self.vectors.sparkSession.createDataFrame([(self.get_vector(a), self.get_vector(b))], "x array<double>, y array<double>")
        return one.select(cosine(F.col("x"), F.col("y"))).first()[0]

    def most_similar(self, positive: Sequence[str], negative: Sequence[str] = (), k: int = 5) -> DataFrame:
        return pooling.most_similar(self.vectors, positive, negative, k)

    def save(self, folder: str) -> None:
        self.vectors.withColumn("architecture", F.lit(self.architecture_name)).write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> WordVectors:
        try:
            rows = spark.read.parquet(folder)
        except AnalysisException as e:
            raise FileNotFoundError(folder) from e
        first = rows.select("architecture").first()
        return WordVectors(rows.select("word", "vector"), first[0] if first else ARCHITECTURES[0])


def sentence_similarity(pairs: DataFrame, vectors: DataFrame, dimensions: int, weights: DataFrame | None = None) -> DataFrame:
    """id, similarity of the pooled vectors of `a` and `b` (token lists; pairs has id, a, b); 0 where either knows no word."""
    pooled = lambda side: pooling.pool(pairs.select("id", F.col(side).alias("tokens")), vectors, dimensions, weights).select("id", F.col("vector").alias(f"_{side}"))
    return pooled("a").join(pooled("b"), "id").select("id", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def corpus_totals(sentences: DataFrame, column: str = "tokens") -> DataFrame:
    """One row: n_sentences, n_tokens, n_words (different tokens)."""
    words = sentences.select(F.explode(column).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sentences.agg(F.count(F.lit(1)).alias("n_sentences")).crossJoin(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_words")))


def _epoch(shared, window: int, rate: float, seed: int):
    """Trains on a partition's sentences; gives what changed: word number, change of its two vectors, 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside, chances = (x.copy() for x in shared.value)
        first, words = (inside.copy(), outside.copy()), np.zeros(len(inside), bool)
        rng = np.random.default_rng(seed)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                n = len(ids)
                if n < 2:
                    continue
                ids = np.array(ids)
                reach = rng.integers(1, window + 1, n)  # near words count more
                at = np.arange(n)
                near = (np.abs(at[:, None] - at) <= reach[:, None]) & (at[:, None] != at)
                share = near / near.sum(1, keepdims=True)
                middle = share @ inside[ids]
                targets = np.concatenate([ids[:, None], np.searchsorted(chances, rng.random((n, NEGATIVES)))], axis=1)
                truth = np.zeros(targets.shape, np.float32)
                truth[:, 0] = 1
                truth[:, 1:][targets[:, 1:] == ids[:, None]] = 1  # a negative that is the word itself teaches nothing wrong
                out = outside[targets]
                push = rate * (truth - 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", middle, out), -30, 30))))
                back = np.einsum("nk,nkd->nd", push, out)
                np.add.at(outside, targets, push[:, :, None] * middle[:, None])
                np.add.at(inside, ids, share.T @ back)
                words[targets] = True
                words[ids] = True
        at = np.flatnonzero(words)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * x.shape[1] + 1, x.shape[1]), pa.int32()), pa.array((x[at] - y[at]).ravel(), pa.float32())) for x, y in zip((inside, outside), first, strict=True)]
        yield pa.record_batch([pa.array(at, pa.int64()), *lists], names=["id", "i", "o"])

    return run


def _mean_change(table: pa.Table) -> pa.Table:
    """The mean change of each word over the partitions that met it."""
    ids, place, count = np.unique(table.column("id").to_numpy(), return_inverse=True, return_counts=True)
    out = []
    for name in ("i", "o"):
        x = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        total = np.zeros((len(ids), x.shape[1]), np.float32)
        np.add.at(total, place, x)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, total.shape[1]), pa.int32()), pa.array((total / count[:, None]).ravel(), pa.float32())))
    return pa.table([pa.array(ids, pa.int64()), *out], names=["id", "i", "o"])


def train_cbow(sentences: DataFrame, column: str = "tokens", size: int = 100, window: int = 5, min_count: int = 2, epochs: int = 50, seed: int = 42, partitions: int = 1) -> DataFrame:
    """word, vector by continuous bags of words with negative sampling; the partitions' models are averaged after every epoch."""
    spark = sentences.sparkSession
    counts = sentences.select(F.explode(column).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    table = sorted((r.word, r.n) for r in counts.collect())  # the vocabulary, which the model has a vector for each of
    if not table:
        raise ValueError("no sentences to train on")
    words = [w for w, _ in table]
    numbers = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    chances = np.cumsum(np.array([n for _, n in table], float) ** 0.75)
    chances /= chances[-1]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            yield pa.record_batch([pa.array([[known[t] for t in s or () if t in known] for s in batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=["ids"])

    encoded = written(sentences.select(column).repartition(partitions).mapInArrow(numbered, "ids array<bigint>"))
    rng = np.random.default_rng(seed)
    inside, outside = ((rng.random((len(words), size)) - 0.5) / size).astype(np.float32), np.zeros((len(words), size), np.float32)
    kind = "id bigint, i array<float>, o array<float>"
    for epoch in range(epochs):
        rate = RATES[0] + (RATES[1] - RATES[0]) * epoch / max(1, epochs - 1)
        shared = spark.sparkContext.broadcast((inside, outside, chances))
        changes = encoded.coalesce(partitions).mapInArrow(_epoch(shared, window, rate, seed + epoch), kind)
        mean = changes.withColumn("b", F.pmod("id", F.lit(partitions))).groupBy("b").applyInArrow(lambda t: _mean_change(t), kind).toArrow()
        at = mean.column("id").to_numpy()
        for x, name in ((inside, "i"), (outside, "o")):
            if len(at):
                x[at] += mean.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
        shared.unpersist()
    return spark.createDataFrame(pa.table([pa.array(words), pa.array(inside.astype(float).tolist(), pa.list_(pa.float64()))], names=["word", "vector"]))
