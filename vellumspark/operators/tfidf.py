"""Term and document frequencies over token arrays, in long form: one row for each (document, term)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_frequency(df: DataFrame, key: Sequence[str], tokens: str) -> DataFrame:
    """key, term, n, tf: occurrences, and their share of the document's tokens. A document without tokens has no rows."""
    rows = df.select(*key, F.size(tokens).alias("_all"), F.explode(tokens).alias("term"))
    return rows.groupBy(*key, "_all", "term").agg(F.count(F.lit(1)).alias("n")).select(*key, "term", "n", (F.col("n") / F.col("_all")).alias("tf"))


def inverse_document_frequency(tf: DataFrame, documents: DataFrame, scope: Sequence[str] = (), smooth: bool = True) -> DataFrame:
    """scope, term, df, idf: smooth ln((N+1)/(df+1))+1, or ln(N/df).

    `documents` has scope and n, the number of documents of each scope (those without tokens count); without a scope it
    is one row.
    """
    df = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(documents, list(scope)) if scope else df.crossJoin(F.broadcast(documents))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1 if smooth else F.log(F.col("n") / F.col("df"))
    return df.select(*scope, "term", "df", idf.alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """tf with tfidf; a term without an idf counts 0."""
    known = idf.select(*scope, "term", "idf")
    return tf.join(known, [*scope, "term"], "left").withColumn("tfidf", F.col("tf") * F.coalesce("idf", F.lit(0.0))).drop("idf")


def top_terms(scores: DataFrame, key: Sequence[str], score: str, k: int) -> DataFrame:
    """The k best terms of each key, with their rank; equal scores in the order of the terms."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col("term"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_cosine(a: DataFrame, b: DataFrame, key: str, weight: str) -> DataFrame:
    """a_key, b_key, similarity of all pairs that share a term: the pairs come from a join on terms, not from all pairs."""
    x = a.select(F.col(key).alias("a_key"), "term", F.col(weight).alias("_wa"))
    y = b.select(F.col(key).alias("b_key"), "term", F.col(weight).alias("_wb"))
    nx = x.groupBy("a_key").agg(F.sqrt(F.sum(F.col("_wa") * F.col("_wa"))).alias("_na"))
    ny = y.groupBy("b_key").agg(F.sqrt(F.sum(F.col("_wb") * F.col("_wb"))).alias("_nb"))
    sums = x.join(y, "term").groupBy("a_key", "b_key").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_d"))
    length = F.col("_na") * F.col("_nb")
    return sums.join(nx, "a_key").join(ny, "b_key").select("a_key", "b_key", F.when(length == 0, 0.0).otherwise(F.col("_d") / length).alias("similarity"))
