"""The current chunks and blocks as items of one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.tables import current_rows, load


def current_chunks(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    """chunk_id and the named columns of the current chunks."""
    return current_rows(load(spark, sf_dir, "chunks"), ["chunk_id"], "indexed_at", list(payload))


def current_documents(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    """doc_id and the named columns of the current documents."""
    return current_rows(load(spark, sf_dir, "documents"), ["doc_id"], "loaded_at", list(payload))


def current_chunk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_kind, owner_id, item_id, text of the current chunks."""
    chunks = current_chunks(spark, sf_dir, "paper_id", "content_text")
    return chunks.select(F.lit("chunk").alias("item_kind"), F.col("paper_id").alias("owner_id"), F.col("chunk_id").alias("item_id"), F.col("content_text").alias("text"))


def current_block_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the current content blocks."""
    blocks = current_rows(load(spark, sf_dir, "content_blocks"), ["doc_id", "block_id"], "extracted_at", ["text"])
    return blocks.select(F.lit("block").alias("item_kind"), F.col("doc_id").alias("owner_id"), F.col("block_id").alias("item_id"), "text")


def current_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_chunk_items(spark, sf_dir).unionByName(current_block_items(spark, sf_dir))
