"""Reciprocal rank fusion of a dense and a lexical ranking, result assembly and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import tokenize


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, dense_weight: float = 1.0, sparse_weight: float = 1.0, pool: int = 25) -> DataFrame:
    """query_id, chunk_id, dense_rank, sparse_rank, dense_score, sparse_score, rrf_score, position.

    dense and sparse have query_id, chunk_id, score, rank. Order: rrf descending (before rounding), the better of the two
    ranks (pool + 1 where missing), chunk_id. rrf_score is rounded to 6 places afterwards.
    """
    if k < 0 or dense_weight < 0 or sparse_weight < 0:
        raise ValueError("k and weights must not be negative")
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    both = both.withColumn("_rrf", part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank"))
    best = F.least(F.coalesce("dense_rank", F.lit(pool + 1)), F.coalesce("sparse_rank", F.lit(pool + 1)))
    order = Window.partitionBy("query_id").orderBy(F.col("_rrf").desc(), best, F.col("chunk_id"))
    return both.withColumn("position", F.row_number().over(order)).withColumn("rrf_score", F.round("_rrf", 6)).drop("_rrf")


def assemble(fused: DataFrame, chunks: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """fused with the payload of its chunks, from `fallback` (the vector table's own copy) where a chunk is not in `chunks`.

    Joined only now, when few rows are left. A chunk that neither knows stops the query.
    """
    payload = [c for c in chunks.columns if c != "chunk_id"]
    out = fused.join(chunks.withColumn("_known", F.lit(True)), "chunk_id", "left")
    if fallback is not None:
        other = fallback.select("chunk_id", F.lit(True).alias("_other"), *[F.col(c).alias(f"_f_{c}") for c in payload if c in fallback.columns])
        out = out.join(other, "chunk_id", "left")
        for c in payload:
            if c in fallback.columns:
                out = out.withColumn(c, F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_f_{c}")))
        known = F.coalesce("_known", "_other", F.lit(False))
    else:
        known = F.coalesce("_known", F.lit(False))
    checked = F.when(known, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("unknown to both retrievers: "), F.col("chunk_id"))))
    return out.withColumn("chunk_id", checked).drop(*[c for c in out.columns if c.startswith("_")])


def overlap_score(query: Column, passage: Column) -> Column:
    """Default scorer: number of different words, in lower case, that query and passage share."""
    return F.size(F.array_intersect(tokenize(F.lower(query)), tokenize(F.lower(passage)))).cast("double")


def rerank(results: DataFrame, top_k: int | None = None, scorer: Callable[[Column, Column], Column] = overlap_score, query: str = "query_text", passage: str = "content_text") -> DataFrame:
    """results with cross_score, final_score and rank: the scorer alone orders, then rrf_score (6 places), then chunk_id.

    A blank query keeps the fused order and gets no cross_score. `scorer` takes two Columns; a model comes as an Arrow
    UDF. Cut the candidates down before: a UDF is not pushed below a limit.
    """
    asked = F.coalesce(F.trim(query) != "", F.lit(False))
    scored = results.withColumn("cross_score", F.when(asked, scorer(F.col(query), F.col(passage))))
    order = Window.partitionBy("query_id").orderBy(F.col("cross_score").desc_nulls_last(), F.when(asked, F.col("rrf_score")).desc_nulls_last(), F.when(asked, F.lit(0)).otherwise(F.col("position")), F.col("chunk_id"))
    out = scored.withColumn("final_score", F.coalesce("cross_score", "rrf_score")).withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= max(top_k, 0))
