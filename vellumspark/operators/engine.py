"""Ingestion, deletion and hybrid search over one collection of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.operators import bm25, dense, hybrid
from vellumspark.operators.chunking import primary_page
from vellumspark.operators.embedding import Embedder, embed, hashing_embedder
from vellumspark.operators.filters import SearchFilter
from vellumspark.operators.store import Collection
from vellumspark.tables import current_rows, measured, written

SCHEMA = "chunk_id string, content_text string, embed_text string, paper_id string, paper_title string, section_title string, section_id string, page_numbers array<int>, is_reference boolean, parent_section_text string, page_number int, embedding array<float>, indexed_at timestamp"


class HybridSearchEngine:
    """A table of chunks with their vectors, and a lexical index of the same chunks.

    `make_embedder` and `scorer` plug models in; without a scorer nothing is reranked. The lexical index lies beside the
    collection's folder unless one is given.
    """

    def __init__(self, collection: Collection, make_embedder: Callable[[], Embedder] = hashing_embedder, scorer: Callable[[Column, Column], Column] | None = None, lexical: bm25.StoredBM25 | None = None):
        self.collection, self.make_embedder, self.scorer = collection, make_embedder, scorer
        self.lexical = lexical or bm25.StoredBM25(collection.spark, f"{collection.folder}-lexical")

    def index(self, chunks: DataFrame) -> int:
        """Embeds and upserts chunks and adds them to the lexical index; of rows with one chunk_id the latest holds. The vectors are made before anything is written. How many chunks there were."""
        rows = chunks.withColumn("page_number", primary_page(F.col("page_numbers"))).withColumn("embedding", embed(F.col("embed_text"), self.make_embedder))
        have = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for c in have:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None))
        kinds = dict(self.collection.read().dtypes)
        ready, seen = measured(current_rows(rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in have]), ["chunk_id"], "indexed_at"), n=F.count(F.lit(1)))
        self.collection.upsert(ready)
        self.lexical.add(ready.select("chunk_id", "embed_text"))
        return seen["n"]

    def delete_paper(self, paper_id: str) -> int:
        """Number of chunks that are gone from either of the two, the greater one."""
        gone = written(self.collection.read().where(F.col("paper_id") == paper_id).select("chunk_id"))
        return max(self.collection.remove(gone), self.lexical.remove(gone))

    def search(
        self,
        queries: DataFrame,
        top_k: int = 5,
        candidate_pool: int = 25,
        dense_weight: float = 1.0,
        sparse_weight: float = 1.0,
        rrf_k: int = 60,
        search_filter: SearchFilter | None = None,
        filter_paper_id: str | None = None,
        rerank: bool = True,
        rerank_pool: int = 20,
    ) -> DataFrame:
        """The hits of each of a bounded set of queries (query_id, query_text), best first by `rank`; blank queries have none.

        The filter holds for both retrievers before anything is ranked: the lexical one tests each page bound against the
        list of pages, the dense one the first page. Statistics come from the whole collection.
        """
        if rrf_k < 0 or dense_weight < 0 or sparse_weight < 0:
            raise ValueError("rrf_k and weights must not be negative")
        pool = max(candidate_pool, top_k)
        rows = self.collection.read()
        asked = queries.where(F.trim("query_text") != "").select("query_id", "query_text")
        chosen = (search_filter or SearchFilter()).scoped(filter_paper_id)
        near = asked.select("query_id", embed(F.col("query_text"), self.make_embedder).alias("query_vector"))
        dense_hits = dense.nearest_to_each(rows.where(chosen.on_page()).select("chunk_id", "embedding"), near, pool)
        allowed = rows.where(chosen.on_pages()) if chosen != SearchFilter() else None
        sparse = bm25.rank_hits(bm25.score_queries(self.lexical.index(), asked, allowed=allowed), pool)
        use = rerank and self.scorer is not None
        fused = hybrid.fuse(dense_hits, sparse, rrf_k, dense_weight, sparse_weight, pool).where(F.col("position") <= (max(top_k, rerank_pool) if use else max(top_k, 0)))
        full = hybrid.assemble(fused, rows.drop("embedding", "indexed_at")).join(asked, "query_id")
        if use:
            return hybrid.rerank(full, top_k, self.scorer)
        return full.withColumn("cross_score", F.lit(None).cast("double")).withColumn("final_score", F.col("rrf_score")).withColumn("rank", F.col("position"))
