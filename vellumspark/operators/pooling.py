"""Word vectors: pooling to sentences, similarity, analogies, training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.prose import prose_sentences
from vellumspark.functions.text import clean_text, tokenize
from vellumspark.functions.vectors import cosine, dot, unit


def pool(tokens: DataFrame, vectors: DataFrame, dimensions: int, weights: DataFrame | None = None, key: str = "id", column: str = "tokens") -> DataFrame:
    """key, vector: the mean of the vectors of a row's known tokens (lower case), or their mean weighted by weights (word, weight; only weights above 0 count, tokens without one are left out). Zeros where no token is known."""
    words = tokens.select(key, F.explode(column).alias("_w")).select(key, F.lower("_w").alias("word"))
    known = words.join(vectors.select("word", "vector"), "word")
    if weights is None:
        known = known.withColumn("weight", F.lit(1.0))
    else:
        known = known.join(weights.select("word", "weight").where("weight > 0"), "word")
    places = known.select(key, "weight", F.posexplode("vector").alias("_d", "_x"))
    sums = places.groupBy(key, "_d").agg((F.sum(F.col("weight") * F.col("_x")) / F.sum("weight")).alias("_m"))
    pooled = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_v"))
    return tokens.select(key).join(pooled, key, "left").select(key, F.coalesce("_v", F.array_repeat(F.lit(0.0), dimensions)).alias("vector"))


def word_similarity(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity for pairs (a, b) of known words; an unknown word stops the query."""
    v = lambda n: vectors.select(F.col("word").alias(n), F.col("vector").alias(f"_{n}"))
    rows = pairs.join(v("a"), "a", "left").join(v("b"), "b", "left")
    missing = F.when(F.col("_a").isNull(), F.col("a")).when(F.col("_b").isNull(), F.col("b"))
    return rows.select("a", "b", F.when(missing.isNull(), cosine(F.col("_a"), F.col("_b"))).otherwise(F.raise_error(F.concat(F.lit("unknown word "), missing)).cast("double")).alias("similarity"))


def most_similar(vectors: DataFrame, positive: Sequence[str], negative: Sequence[str] = (), k: int = 5) -> DataFrame:
    """word, similarity: nearest to the sum of the positive words' unit vectors less the negative ones'; those words left out."""
    low = [w.lower() for w in (*positive, *negative)]
    sign = {**{w.lower(): 1.0 for w in positive}, **{w.lower(): -1.0 for w in negative}}
    units = vectors.select("word", unit(F.col("vector")).alias("_u"))
    own = units.where(F.col("word").isin(*low)).select("word", "_u")
    factor = F.element_at(F.create_map(*[F.lit(x) for w, s in sign.items() for x in (w, s)]), F.col("word"))
    target = own.select(factor.alias("_s"), F.posexplode("_u").alias("_d", "_x")).groupBy("_d").agg(F.sum(F.col("_s") * F.col("_x")).alias("_m"))
    target = target.agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_t"))  # one row of as many numbers as a vector has
    found = own.agg(F.count(F.lit(1)).alias("_n")).crossJoin(target)
    known = F.when(F.col("_n") == len(set(low)), F.col("_t")).otherwise(F.raise_error(F.lit("unknown word")).cast("array<double>"))
    rows = units.where(~F.col("word").isin(*low)).crossJoin(F.broadcast(found))
    return rows.select("word", (dot(F.col("_u"), known) / F.sqrt(dot(known, known))).alias("similarity")).orderBy(F.col("similarity").desc(), "word").limit(k)


def training_sentences(text: Column) -> Column:
    """Token lists for training: prose sentences of the cleaned text, tokens of two letters or more in lower case, three tokens or more."""
    sentences = F.transform(prose_sentences(clean_text(text)), lambda s: F.filter(F.transform(tokenize(s), F.lower), lambda t: F.length(t) > 1))
    return F.filter(sentences, lambda t: F.size(t) >= 3)


def train(sentences: DataFrame, column: str = "tokens", size: int = 100, window: int = 5, min_count: int = 2, iterations: int = 5, seed: int = 42, partitions: int = 1) -> DataFrame:
    """word, vector by MLlib's skip-gram. An empty table is an error."""
    from pyspark.ml.feature import Word2Vec

    if sentences.limit(1).count() == 0:
        raise ValueError("no sentences to train on")
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, numPartitions=partitions, inputCol=column, outputCol="_v").fit(sentences.select(column))
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
