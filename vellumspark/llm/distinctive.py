"""How characteristic a term is of a record: log-entropy weighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_terms(df: DataFrame, key: Sequence[str], terms: Column) -> DataFrame:
    """First aggregation: key, term, tf (occurrences of the term in the record). Null terms are no terms."""
    return df.select(*key, F.explode(terms).alias("term")).where(F.col("term").isNotNull()).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(counts: DataFrame, kind: Sequence[str] = ()) -> DataFrame:
    """Second aggregation: kind, term, df (records), gf (occurrences), entropy (natural) of the term's spread over records.

    With tf_d summing to gf the entropy -sum(p ln p), p = tf_d / gf, is ln gf - sum(tf_d ln tf_d) / gf, so one pass of
    sums does, and a term in every record shrinks to one row in each map task before the shuffle.
    """
    sums = counts.groupBy(*kind, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log("tf")).alias("_s"))
    return sums.select(*kind, "term", "df", "gf", F.greatest(F.log("gf") - F.col("_s") / F.col("gf"), F.lit(0.0)).alias("entropy"))


def log_entropy(counts: DataFrame, records: DataFrame, kind: Sequence[str] = ()) -> DataFrame:
    """counts of `count_terms` with df, gf, n, weight and score.

    weight  1 - entropy / ln n, n the number of records of the kind (records: kind, n): 1 for a term of a single record,
            0 for one spread evenly over all records, and 1 for every term of a lone record
    score   log2(1 + tf) * weight

    The weights join the counts on (kind, term). A term held by a large part of all records makes a skewed key of that
    join; adaptive execution splits it, as the weights have one row a term.
    """
    n = F.broadcast(records) if kind else records  # one row for each kind of record
    weights = term_weights(counts, kind)
    weights = weights.join(n, list(kind)) if kind else weights.crossJoin(F.broadcast(n))
    weight = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - F.col("entropy") / F.log("n"))).otherwise(F.lit(1.0))
    out = counts.join(weights.select(*kind, "term", "df", "gf", "n", weight.alias("weight")), [*kind, "term"])
    return out.withColumn("score", F.log2(1 + F.col("tf")) * F.col("weight"))


def least_score(tf: int, df: int, n: Column) -> Column:
    """No term has a smaller score that occurs `tf` times or more in its record and in at most `df` of n records: its entropy is at most ln df. Rounding is allowed for."""
    weight = F.when(n > 1, F.greatest(F.lit(0.0), 1 - F.log(F.lit(float(df))) / F.log(n))).otherwise(F.lit(1.0))
    return F.log2(F.lit(1.0 + tf)) * weight - 1e-9
