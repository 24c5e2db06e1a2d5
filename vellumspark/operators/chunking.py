"""Section-aware chunks of sentences under a token budget, with overlap and without orphans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.prose import Split, is_reference_title, segment
from vellumspark.functions.text import clean_text, token_estimate, word_count

#: What a page adds to a block's ordinal.
PAGE_STEP = 100_000
BOUNDS = "array<struct<first:int,end:int,tail:int>>"


@dataclass(frozen=True)
class ChunkingConfig:
    max_tokens: int = 300
    overlap_tokens: int = 50
    min_tokens: int = 30
    prepend_headers: bool = True


def chunk_bounds(tokens: Sequence[int], config: ChunkingConfig = ChunkingConfig()) -> list[tuple[int, int, int]]:
    """(first, end, tail) of each chunk of a section: sentences [first, end), and [tail, n) joined on where tail < n.

    A sentence at the limit stands alone; others are taken while they fit. The next chunk goes back over as many whole
    sentences as the overlap holds, if that is fewer than the chunk has. What is left under the least size, overlap
    included, is joined to the chunk before; sentences that are in both then stand twice.
    """
    n, sums = len(tokens), [0]
    for t in tokens:
        sums.append(sums[-1] + t)
    out: list[tuple[int, int, int]] = []
    at = 0
    while at < n:
        if out and sums[n] - sums[at] < config.min_tokens:
            out[-1] = (*out[-1][:2], at)
            break
        end = at + 1 if tokens[at] >= config.max_tokens else bisect_right(sums, sums[at] + config.max_tokens) - 1
        out.append((at, end, n))
        back = end - bisect_left(sums, sums[end] - config.overlap_tokens) if end < n and config.overlap_tokens > 0 else 0
        at = end - back if 0 < back < end - at else end
    return out


def _bounds_column(tokens: Column, config: ChunkingConfig) -> Column:
    @F.arrow_udf(BOUNDS)
    def bounds(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("tail", pa.int32())]))
        return pa.array([[dict(zip(("first", "end", "tail"), b, strict=True)) for b in chunk_bounds(t, config)] for t in column.to_pylist()], kind)

    return bounds(tokens)


def section_runs(blocks: DataFrame, sections: DataFrame, least_words: int = 3) -> DataFrame:
    """doc_id, run, section_title, section_id, ordinal, block_id, page_number, text: cleaned blocks in runs of one section title.

    `run` counts from 1; neighbouring blocks of the same title are one run, whose section_id is its first block's.
    Blocks of fewer than `least_words` words are left out; a missing title is "Main Content".
    """
    titled = sections.select("doc_id", "section_id", F.col("title").alias("_title"))
    rows = blocks.join(titled, ["doc_id", "section_id"], "left").withColumn("text", clean_text(F.col("text"))).where(word_count(F.col("text")) >= least_words)
    rows = rows.withColumn("section_title", F.coalesce(F.nullif("_title", F.lit("")), F.lit("Main Content")))
    # runs are counted within pages and across them, so that no task holds a whole document
    rows = rows.withColumn("_part", F.floor(F.col("ordinal") / PAGE_STEP))
    place = F.struct("ordinal", "block_id")
    page = Window.partitionBy("doc_id", "_part").orderBy("ordinal", "block_id")
    rows = rows.withColumn("_new", F.coalesce((F.lag("section_title").over(page) != F.col("section_title")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_here", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    pages = rows.groupBy("doc_id", "_part").agg(F.sum("_new").alias("_changes"), F.min_by("section_title", place).alias("_head"), F.max_by("section_title", place).alias("_foot"))
    book = Window.partitionBy("doc_id").orderBy("_part")  # one row a page
    pages = pages.withColumn("_begins", F.coalesce((F.lag("_foot").over(book) != F.col("_head")).cast("int"), F.lit(1)))
    pages = pages.withColumn("_earlier", F.sum(F.col("_begins") + F.col("_changes")).over(book.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_changes"))
    rows = rows.join(pages.select("doc_id", "_part", "_earlier"), ["doc_id", "_part"]).withColumn("run", F.col("_earlier") + F.col("_here"))
    first = rows.groupBy("doc_id", "run").agg(F.min_by("section_id", place).alias("section_id"))
    return rows.drop("section_id").join(first, ["doc_id", "run"]).select("doc_id", "run", "section_title", "section_id", "ordinal", "block_id", "page_number", "text")


def sentence_units(runs: DataFrame, split: Split = segment) -> DataFrame:
    """doc_id, run, section_title, section_id, parent, units: the sentences of each run in order, and its whole text."""
    block = F.array_sort(F.collect_list(F.struct("ordinal", "block_id", "page_number", "text")))
    grouped = runs.groupBy("doc_id", "run").agg(F.first("section_title").alias("section_title"), F.first("section_id").alias("section_id"), block.alias("_blocks"))
    unit = lambda b: F.transform(split(b["text"]), lambda s: F.struct(s.alias("text"), token_estimate(s).cast("int").alias("tokens"), b["page_number"].alias("page"), b["block_id"].alias("block")))
    return grouped.select("doc_id", "run", "section_title", "section_id", F.array_join(F.transform("_blocks", lambda b: b["text"]), " ").alias("parent"), F.flatten(F.transform("_blocks", unit)).alias("units"))


def chunk_documents(blocks: DataFrame, sections: DataFrame, papers: DataFrame, config: ChunkingConfig = ChunkingConfig(), split: Split = segment, with_parent: bool = True) -> DataFrame:
    """The chunks of all documents.

    `papers` has doc_id, paper_id, title. A run of blocks is put together in one row, as its text is a column of its
    chunks (parent_section_text, null without `with_parent`). Only the boundaries come from Python; texts stay in the JVM.
    `split` takes a text to its sentences.
    """
    units = sentence_units(section_runs(blocks, sections), split).where(F.size("units") > 0)
    cut = units.withColumn("_bounds", _bounds_column(F.transform("units", lambda u: u["tokens"]), config))
    # each chunk's own sentences are taken out before rows are made, so that no chunk carries its whole section
    own = lambda b: F.concat(F.slice("units", b["first"] + 1, b["end"] - b["first"]), F.slice("units", b["tail"] + 1, F.greatest(F.size("units") - b["tail"], F.lit(0))))
    parent = F.col("parent") if with_parent else F.lit(None).cast("string").alias("parent")
    chunks = F.transform("_bounds", lambda b: F.struct(b.alias("b"), own(b).alias("own")))
    rows = cut.select("doc_id", "run", "section_title", "section_id", parent, F.posexplode_outer(chunks).alias("_n", "_c")).where("_c is not null")  # outer: no filter on the function is inferred below it
    rows = rows.select("doc_id", "run", "section_title", "section_id", "parent", "_n", F.col("_c.own").alias("_own"), F.col("_c.b").alias("_b"))
    rows = rows.join(papers.select("doc_id", "paper_id", F.col("title").alias("paper_title")), "doc_id", "left")
    text = F.array_join(F.transform("_own", lambda u: u["text"]), " ")
    pages = F.array_sort(F.array_distinct(F.transform("_own", lambda u: u["page"])))
    rows = rows.withColumn("content_text", text).withColumn("page_numbers", pages)
    title = F.coalesce("paper_title", F.lit("Untitled Paper"))
    named = F.when(F.size("page_numbers") == 1, F.concat(F.lit("Page "), F.get("page_numbers", F.lit(0)))).otherwise(F.concat(F.lit("Pages "), F.get("page_numbers", F.lit(0)), F.lit("-"), F.element_at("page_numbers", -1)))
    header = F.concat(F.lit("[Document: "), title, F.lit(" | Section: "), F.col("section_title"), F.lit(" | "), named, F.lit("]\n\n"))
    reference = is_reference_title(F.col("section_title"))
    return rows.select(
        F.concat(F.coalesce("paper_id", F.lit("paper")), F.lit("_s"), F.col("run"), F.lit("_c"), F.col("_n") + 1).alias("chunk_id"),
        "doc_id",
        "paper_id",
        title.alias("paper_title"),
        "section_title",
        "section_id",
        "content_text",
        (F.concat(header, "content_text") if config.prepend_headers else F.col("content_text")).alias("embed_text"),
        token_estimate(F.col("content_text")).alias("token_count"),
        F.length("content_text").cast("bigint").alias("char_count"),
        "page_numbers",
        F.array_sort(F.array_distinct(F.transform("_own", lambda u: u["block"]))).alias("source_block_ids"),
        F.when(reference, F.lit("reference")).otherwise(F.lit("prose")).alias("chunk_type"),
        reference.alias("is_reference"),
        F.col("parent").alias("parent_section_text"),
        F.col("_b.first").alias("first_sentence"),
        F.col("_b.end").alias("end_sentence"),
    )


def primary_page(page_numbers: Column) -> Column:
    """The first page, 1 without any."""
    return F.coalesce(F.get(page_numbers, F.lit(0)), F.lit(1))


def chunk_statistics(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number, mean, population deviation, least and greatest tokens of chunks, and how many span pages."""
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.avg("token_count").alias("mean_tokens"),
        F.stddev_pop("token_count").alias("std_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.count_if(F.size("page_numbers") > 1).alias("multi_page"),
    )
