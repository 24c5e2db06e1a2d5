"""BM25 over a postings table, for one query or a table of queries.

Statistics come from the whole corpus; filters only choose what is ranked.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.functions.stopwords import SEARCH_STOPWORDS
from vellumspark.functions.text import search_terms
from vellumspark.operators.filters import SearchFilter
from vellumspark.operators.store import Collection

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class BM25Index:
    """postings: term, chunk_id, tf, len. terms: term, df. corpus: one row of n_chunks, avg_len."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @staticmethod
    def build(chunks: DataFrame, text: str = "embed_text") -> BM25Index:
        """From current chunks (chunk_id, text). Chunks without terms count in the corpus. Rows already lie by chunk, so counting them shuffles nothing."""
        tokens = chunks.select("chunk_id", search_terms(F.col(text)).alias("_t"))
        lengths = tokens.select("chunk_id", F.size("_t").cast("bigint").alias("len"))
        exploded = tokens.select("chunk_id", F.size("_t").cast("bigint").alias("len"), F.explode("_t").alias("term"))
        postings = exploded.groupBy("chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "chunk_id", "tf", "len")
        return BM25Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), lengths.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len")))

    def idf(self, asked: DataFrame | None = None) -> DataFrame:
        """term, df, idf: ln(1 + (N - df + 0.5) / (df + 0.5)), never negative. `asked` (term) restricts it."""
        terms = self.terms if asked is None else self.terms.join(asked, "term", "left_semi")
        rows = terms.crossJoin(F.broadcast(self.corpus))  # the corpus is one row
        return rows.select("term", "df", F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


class StoredBM25:
    """An index kept below a folder, in segments: adding writes the postings of the new chunks alone, and which segment of a chunk holds is a table of its own.

    Chunks that are added again replace their older form; removed ones leave their postings behind until `compact`, which
    writes one segment of what is live. Postings of a segment are sorted by term, so that a query reads the row groups of
    its terms. Every change ends by writing the next version of the live table; readers see the last complete one.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.live = Collection(spark, f"{self.folder}/live", "chunk_id string, segment string, len bigint", ["chunk_id"], buckets)

    def fit(self, chunks: DataFrame, text: str = "embed_text") -> None:
        """The chunks alone; what was there before is gone."""
        self.live.clear()
        self.add(chunks, text)

    def add(self, chunks: DataFrame, text: str = "embed_text") -> None:
        """Current chunks (chunk_id, text), each once; those that are there already are replaced."""
        segment = uuid.uuid4().hex
        tokens = chunks.select("chunk_id", search_terms(F.col(text)).alias("_t"))
        rows = tokens.select("chunk_id", F.size("_t").cast("bigint").alias("len"), F.explode_outer("_t").alias("term"))
        rows = rows.groupBy("chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
        self._write(rows, segment)
        # a chunk without terms has one row, of a null term
        there = self._segment(segment)
        self.live.upsert(there.select("chunk_id", F.lit(segment).alias("segment"), "len").distinct())

    def remove(self, chunk_ids: DataFrame) -> int:
        """The number of chunks (chunk_id) that were there and are gone."""
        return self.live.remove(chunk_ids)

    def compact(self) -> None:
        segment = uuid.uuid4().hex
        live = self.live.read()
        self._write(self._postings(live, outer=True).select("chunk_id", "len", "term", "tf"), segment)
        self.live.upsert(self._segment(segment).select("chunk_id", F.lit(segment).alias("segment"), "len").distinct())
        fs, folder = self.live._fs(f"{self.folder}/postings")
        for status in fs.listStatus(folder):
            if status.getPath().getName() != f"segment={segment}":
                fs.delete(status.getPath(), True)

    def _write(self, rows: DataFrame, segment: str) -> None:
        rows.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.parquet(f"{self.folder}/postings/segment={segment}")

    def _segment(self, segment: str) -> DataFrame:
        return self.spark.read.schema("chunk_id string, len bigint, term string, tf bigint").parquet(f"{self.folder}/postings/segment={segment}")

    def _postings(self, live: DataFrame, outer: bool = False) -> DataFrame:
        segments = [r[0] for r in live.select("segment").distinct().collect()]  # one for each addition since the last compact
        kind = "chunk_id string, len bigint, term string, tf bigint, segment string"
        if not segments:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).option("basePath", f"{self.folder}/postings").parquet(*[f"{self.folder}/postings/segment={s}" for s in segments])
        if not outer:
            rows = rows.where("term is not null")
        return rows.join(live.select("chunk_id", "segment"), ["chunk_id", "segment"], "left_semi")

    def index(self) -> BM25Index:
        """For queries. Document frequencies are counted over the postings of the terms asked for."""
        live = self.live.read()
        postings = self._postings(live).select("term", "chunk_id", "tf", "len")
        corpus = live.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
        return BM25Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), corpus)


def query_terms(text: Column, stopwords: Sequence[str] = SEARCH_STOPWORDS, filter_stopwords: bool = True) -> Column:
    """Terms of a query, repeats kept: of more than two, those that are no stop words, or all if every one is."""
    raw = search_terms(text)
    if not filter_stopwords:
        return raw
    kept = F.filter(raw, lambda t: ~t.isin(*stopwords))
    return F.when((F.size(raw) > 2) & (F.size(kept) > 0), kept).otherwise(raw)


def score_queries(index: BM25Index, queries: DataFrame, query_id: str = "query_id", text: str = "query_text", filter_stopwords: bool = True, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, raw: scores above 0 of all chunks that share a term with a query; a query's repeated terms count repeatedly.

    `allowed` (chunk_id) restricts what is scored, before anything is scored; statistics stay those of the whole corpus.
    Postings of the queries' terms lie by chunk when the queries' weights come to them, so that a chunk's scores are summed
    where they arise: the many pairs of query and posting are not shuffled where the weights are small enough to be sent to
    every task, which Spark decides by their size.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(query_terms(F.col(text), filter_stopwords=filter_stopwords)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = wanted.select("term").distinct()
    idf = index.idf(asked)
    weighted = wanted.join(idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("_w"))
    postings = index.postings.join(asked, "term", "left_semi")
    if allowed is not None:
        postings = postings.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest(F.lit(1.0), F.col("avg_len"))))
    parts = postings.crossJoin(F.broadcast(index.corpus.select("avg_len"))).select("term", "chunk_id", saturation.alias("_s")).repartition("chunk_id")
    return parts.join(weighted, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("_w") * F.col("_s")).alias("raw")).where("raw > 0")


def rank_hits(scores: DataFrame, k: int = 25) -> DataFrame:
    """query_id, chunk_id, score, rank: scores rounded to 4 places order first, then chunk_id."""
    rounded = scores.select("query_id", "chunk_id", F.round("raw", 4).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.asc_nulls_last("chunk_id"))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: BM25Index, chunks: DataFrame, query: str, k: int = 25, search_filter: SearchFilter | None = None, filter_paper_id: str | None = None, filter_stopwords: bool = True) -> DataFrame:
    """chunk_id, score, rank of one query over the chunks that the filter lets through."""
    queries = chunks.sparkSession.createDataFrame([(0, query)], "query_id bigint, query_text string")
    chosen = (search_filter or SearchFilter()).scoped(filter_paper_id or None)
    allowed = chunks.where(chosen.on_pages()) if chosen != SearchFilter() else None
    return rank_hits(score_queries(index, queries, filter_stopwords=filter_stopwords, allowed=allowed), k).drop("query_id")


def search_each(index: BM25Index, chunks: DataFrame, queries: DataFrame, k: int = 25, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    """query_id, chunk_id, score, rank for queries with filters of their own (filter_paper_id, min_page, max_page; null or empty doesn't filter).

    Queries that name a paper are scored against the chunks of those papers alone, so that their terms meet no other
    postings; page bounds look at a chunk's own pages.
    """
    rule = F.nullif(F.col("filter_paper_id"), F.lit(""))
    filters = queries.select(F.col(query_id).alias("query_id"), rule.alias("_p"), F.col("min_page").alias("_min"), F.col("max_page").alias("_max"))
    pages = chunks.select("chunk_id", "paper_id", F.array_max("page_numbers").alias("_last"), F.array_min("page_numbers").alias("_first"))
    named, free = queries.where(rule.isNotNull()), queries.where(rule.isNull())
    papers = named.select(rule.alias("paper_id")).distinct()
    hits = score_queries(index, free, query_id, text).unionByName(score_queries(index, named, query_id, text, allowed=chunks.join(papers, "paper_id", "left_semi")))
    within = (F.col("_p").isNull() | (F.col("paper_id") == F.col("_p"))) & (F.col("_min").isNull() | F.coalesce(F.col("_last") >= F.col("_min"), F.lit(False))) & (F.col("_max").isNull() | F.coalesce(F.col("_first") <= F.col("_max"), F.lit(False)))
    return rank_hits(hits.join(filters, "query_id").join(pages, "chunk_id").where(within).select("query_id", "chunk_id", "raw"), k)
