"""From raw layout blocks to a searchable table of blocks: parse, embed, store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import metadata as md
from vellumspark.operators.embedding import Embedder, embed_blocks, hashing_embedder
from vellumspark.operators.parsing import parse_documents
from vellumspark.operators.store import Collection, prepare_blocks
from vellumspark.tables import measured

SCHEMA = "paper_id string, block_id string, text string, page_number int, section_id string, section_title string, paper_title string, embedding array<float>, metadata map<string,string>"


def store_blocks(blocks: DataFrame, collection: Collection) -> int:
    """Upserts embedded blocks (paper_id, block_id, ...); how many there are."""
    rows, seen = measured(prepare_blocks(blocks, "paper_title").select(*[f.split(" ")[0] for f in SCHEMA.split(", ")]), n=F.count(F.lit(1)))
    collection.upsert(rows)
    return seen["n"]


def index_documents(raw: DataFrame, embedded: DataFrame, collection: Collection, make: Callable[[], Embedder] = hashing_embedder, least_words: int = 8, **records: DataFrame) -> int:
    """Blocks of at least `least_words` words of all documents, embedded and stored under their paper's key (not sanitised); how many. `raw`, `embedded` and `records` as parse_documents takes them."""
    papers, sections, blocks = parse_documents(raw, embedded, **records)
    key = md.paper_key(F.col("arxiv_id"), F.col("doi"), F.col("title"), sanitise=False)
    named = papers.select("doc_id", key.alias("paper_id"), F.col("title").alias("paper_title"))
    rows = embed_blocks(blocks, sections, least_words, make).join(named, "doc_id").withColumn("metadata", F.create_map().cast("map<string,string>"))
    return store_blocks(rows, collection)
