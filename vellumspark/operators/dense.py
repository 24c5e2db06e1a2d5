"""Exact cosine search, and upkeep of a table of vectors."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.vectors import cosine, dot
from vellumspark.operators.filters import SearchFilter, compile_where

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def nearest_to_one(vectors: DataFrame, query: DataFrame | list[float], k: int = 5, where: Column | None = None, id_: str = "block_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector, with score (cosine, 4 places), distance and rank; ties in the order of `id_`.

    `query` is a list or a DataFrame of one row with a column `query_vector`. The scan is pruned by `where`, and each
    task keeps k rows (TakeOrderedAndProject).
    """
    rows = vectors if where is None else vectors.where(where)
    if isinstance(query, DataFrame):
        rows, target = rows.crossJoin(F.broadcast(query.select("query_vector").limit(1))), F.col("query_vector")
    else:
        target = F.lit([float(x) for x in query])
    scored = rows.withColumn("score", F.round(cosine(F.col(vector), target), 4)).withColumn("distance", F.round(1 - F.col("score"), 4)).drop("query_vector")
    top = scored.orderBy(F.col("score").desc(), F.col(id_)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(id_))))  # over k rows


def _best(k: int, ids: pa.DataType, query_ids: pa.DataType):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        asked, found, scores = [], [], []
        if rows.num_rows and queries.num_rows:
            names = np.array(rows.column("id").to_pylist(), dtype=object)
            vectors = rows.column("v").to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if v and None not in v:
                    by_length.setdefault(len(v), []).append(i)
            for me, q in zip(queries.column("id").to_pylist(), queries.column("v").to_pylist(), strict=True):
                at = by_length.get(len(q or ()), [])
                if not at or None in q:
                    continue
                if isinstance(at, list):  # made into a matrix once
                    x = np.array([vectors[i] for i in at], dtype=np.float64)
                    by_length[len(q)] = at = (np.array(at), x, np.linalg.norm(x, axis=1))
                place, x, length = at
                q = np.array(q, dtype=np.float64)
                product = length * np.linalg.norm(q)
                with np.errstate(invalid="ignore", divide="ignore"):
                    cosines = np.where(product == 0, 0.0, x @ q / product)
                good = np.isfinite(cosines)
                place, rounded = place[good], np.floor(cosines[good] * 1e4 + 0.5) / 1e4
                if len(place) > k:
                    keep = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
                    place, rounded = place[keep], rounded[keep]
                best = sorted(zip((-rounded).tolist(), names[place].tolist(), strict=True))[:k]
                asked += [me] * len(best)
                found += [n for _, n in best]
                scores += [-c for c, _ in best]
        return pa.table([pa.array(asked, query_ids), pa.array(found, ids), pa.array(scores, pa.float64())], names=["query_id", "id", "score"])

    return run


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int = 25, id_: str = "chunk_id", vector: str = "embedding", part_rows: int = 50_000, part_queries: int = 5_000) -> DataFrame:
    """query_id, id, score, rank: the k nearest of a stated set of queries (query_id, query_vector) by cosine (4 places; ties in the order of `id_`), which is held against all rows in blocks.

    Rows and queries are cut into parts by their hash; a part of queries meets every part of rows, and only the k best of a
    part leave its task. Vectors that are null, hold a null or a number that isn't finite, or are not as long as the
    query's, are no rows; a vector without length has a score of 0.
    """
    parts, sides = max(1, math.ceil(vectors.count() / part_rows)), max(1, math.ceil(queries.count() / part_queries))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v")).select("id", "v", place(parts).alias("x"), spread(sides).alias("y"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("query_vector").alias("v")).select("id", "v", place(sides).alias("y"), spread(parts).alias("x"))
    kinds = dict(vectors.dtypes)[id_], dict(queries.dtypes)["query_id"]
    best = rows.groupBy("x", "y").cogroup(asked.groupBy("x", "y")).applyInArrow(_best(k, ARROW[kinds[0]], ARROW[kinds[1]]), f"query_id {kinds[1]}, id {kinds[0]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_), "score", "rank")


def nearest_to_text(vectors: DataFrame, text: str, embed: Callable[[Column], Column], k: int = 5, where: dict[str, Any] | None = None, search_filter: SearchFilter | None = None, id_: str = "block_id") -> DataFrame:
    """The k rows nearest to a text, embedded as the rows were; nothing for a blank text. `search_filter` is used instead of `where` if both are given. A missing page is 1, a missing paper "unknown"."""
    condition = search_filter.on_page() if search_filter is not None else compile_where(where) if where else None
    query = vectors.sparkSession.createDataFrame([(text if text and text.strip() else "",)], "t string").select(embed(F.col("t")).alias("query_vector"))
    rows = vectors if text and text.strip() else vectors.limit(0)
    for name, missing in (("page_number", F.lit(1)), ("paper_id", F.lit("unknown"))):
        if name in rows.columns:
            rows = rows.withColumn(name, F.coalesce(F.col(name), missing))
    return nearest_to_one(rows, query, k, condition, id_)


def best_sentence(sentences: DataFrame, queries: DataFrame, key: str = "id") -> DataFrame:
    """query_id, key, similarity: for each query (query_id, query_vector) the sentence (key, vector) of the greatest cosine, the first key of those; vectors without length are like nothing. Null ids are none."""
    return nearest_to_each(sentences.where(F.col(key).isNotNull()), queries, 1, key, "vector").select("query_id", key, F.col("score").alias("similarity"))


def by_dot_product(vectors: DataFrame, query: list[float], k: int = 5, id_: str = "block_id", vector: str = "embedding") -> DataFrame:
    """Search in memory's order: raw dot product, no normalising."""
    return vectors.withColumn("score", dot(F.col(vector), F.lit([float(x) for x in query]))).orderBy(F.col("score").desc(), F.col(id_)).limit(k)
