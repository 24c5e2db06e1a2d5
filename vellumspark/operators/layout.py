"""From layout blocks to sections: inline headings, headings of several lines, classification, hierarchy.

Raw blocks have doc_id, block_id, ordinal, text, page_number, bbox (x0, y0, x1, y1) and spans (struct of text, font_size,
font, flags).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellumspark.functions.headings import formatting, heading_level, is_blank_span, is_bold, is_false_heading, is_numbered, looks_unnumbered
from vellumspark.functions.text import strip_ws, word_count

SPANS = "array<struct<text:string,font_size:double,font:string,flags:int>>"
BLOCK = "struct<block_id:string,ordinal:bigint,part:int,text:string,page_number:int,bbox:array<double>,spans:array<struct<text:string,font_size:double,font:string,flags:int>>>"


def _joined(spans: Column) -> Column:
    return strip_ws(F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), " "))


def split_inline_headings(blocks: DataFrame) -> DataFrame:
    """Blocks that begin with 2 to 10 bold words and go on in regular type become a heading (id + "_h") and a paragraph (id + "_p") of the same place. Adds `part` (0, or 1 for the paragraph)."""
    regular = F.array_position(F.transform("spans", lambda s, i: ~(is_bold(s) | (is_blank_span(s) & (i > 0)))), True) - 1
    lead = F.slice("spans", 1, F.greatest(F.col("_cut"), F.lit(0)))
    rest = F.slice("spans", F.greatest(F.col("_cut"), F.lit(0)) + 1, F.greatest(F.size("spans") - F.col("_cut"), F.lit(0)))
    rows = blocks.withColumn("_cut", F.coalesce(regular, F.lit(-1)).cast("int"))
    cut = (F.col("_cut") > 0) & word_count(_joined(lead)).between(2, 10)

    def part(suffix: str, spans: Column, number: int) -> Column:
        return F.struct(F.concat("block_id", F.lit(suffix)).alias("block_id"), F.lit(number).alias("part"), (_joined(spans) if suffix else F.col("text")).alias("text"), spans.alias("spans"))

    rows = rows.withColumn("_parts", F.when(cut, F.array(part("_h", lead, 0), part("_p", rest, 1))).otherwise(F.array(part("", F.col("spans"), 0))))
    return rows.select("doc_id", "ordinal", "page_number", "bbox", F.explode("_parts").alias("_q")).select("doc_id", "_q.block_id", "ordinal", "_q.part", "_q.text", "page_number", "bbox", "_q.spans")


RUNS = "array<struct<start:int,count:int>>"


def heading_runs(rows: Sequence[dict]) -> list[tuple[int, int]]:
    """(first, number) of the blocks of a page that are one: a fold, as the lines merged so far are what the next is held against. Each row has size, bold, numbered, chars and bbox."""
    out: list[tuple[int, int]] = []
    size = chars = 0
    bold, box = False, None
    for i, r in enumerate(rows):
        own = r["bbox"]
        known = own is not None and len(own) == 4 and None not in own
        if out and bold and r["bold"] and not r["numbered"] and box and known and abs(size - r["size"]) <= 0.2 and chars + 1 + r["chars"] <= 200:
            gap = own[1] - box[3]
            if -5.0 <= gap <= max(20.0, 1.8 * size) and min(box[2], own[2]) > max(box[0], own[0]):
                out[-1] = (out[-1][0], out[-1][1] + 1)
                size, chars = max(size, r["size"]), chars + 1 + r["chars"]
                box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
                continue
        out.append((i, 1))
        size, chars, bold, box = r["size"], r["chars"], r["bold"], own if known else None
    return out


def merge_heading_lines(blocks: DataFrame) -> DataFrame:
    """Neighbouring bold lines of one size and place become one block. Lines merge within a page only, so a page is all that comes together in a row; which lines merge is told from their measures, texts stay in the JVM."""

    @F.arrow_udf(RUNS)
    def runs(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())]))
        return pa.array([[{"start": a, "count": n} for a, n in heading_runs(p)] for p in pages.to_pylist()], kind)

    item = F.struct("block_id", F.col("ordinal").cast("bigint").alias("ordinal"), "part", "text", F.col("page_number").cast("int").alias("page_number"), F.col("bbox").cast("array<double>").alias("bbox"), "spans").cast(BLOCK)
    look = formatting(F.col("spans"))
    measure = F.struct(look["size"].alias("size"), look["bold"].alias("bold"), is_numbered(strip_ws("text")).alias("numbered"), F.length(strip_ws("text")).alias("chars"), F.col("bbox").cast("array<double>").alias("bbox"))
    rows = blocks.where(strip_ws("text") != "").select("doc_id", "page_number", "ordinal", "part", item.alias("b"), measure.alias("m"))
    pages = rows.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part", "b", "m"))).alias("_page"))
    found = pages.select("doc_id", F.col("_page.b").alias("_b"), runs(F.col("_page.m")).alias("_runs"))
    lines = found.select("doc_id", F.explode(F.transform("_runs", lambda r: F.slice("_b", r["start"] + 1, r["count"]))).alias("_l"))
    head = lambda name: F.get("_l", F.lit(0))[name]
    several = F.size("_l") > 1
    edge = lambda i: (F.array_min if i < 2 else F.array_max)(F.transform("_l", lambda b: b["bbox"][i]))
    return lines.select(
        "doc_id",
        head("block_id").alias("block_id"),
        head("ordinal").alias("ordinal"),
        head("part").alias("part"),
        F.when(several, F.array_join(F.transform("_l", lambda b: strip_ws(b["text"])), " ")).otherwise(head("text")).alias("text"),
        head("page_number").alias("page_number"),
        F.when(several, F.array(*[edge(i) for i in range(4)])).otherwise(head("bbox")).alias("bbox"),
        F.flatten(F.transform("_l", lambda b: F.coalesce(b["spans"], F.array().cast(SPANS)))).alias("spans"),
    )


def classify(blocks: DataFrame) -> DataFrame:
    """Adds level (null for paragraphs): numbered headings by their number, other headings 2, candidates on page 1 between title and abstract none."""
    rows = blocks.withColumn("text", strip_ws("text")).where("text <> ''").withColumn("_f", formatting(F.col("spans")))
    size, bold, first = F.col("_f.size"), F.col("_f.bold"), F.col("_f.first_size")
    false = is_false_heading(F.col("text"), size, first)
    numbered = is_numbered(F.col("text")) & ~false & (bold | (size > 11.0))
    plain = looks_unnumbered(F.col("text"), size, bold) & ~false
    rows = rows.withColumn("_level", F.when(numbered, heading_level(F.col("text"))).when(plain, F.lit(2)).cast("int"))
    begins = (F.lower("text") == "abstract") | F.col("text").startswith("1 ") | F.col("text").startswith("1. ")
    # only first pages take part in the windows
    page = Window.partitionBy("doc_id").orderBy("ordinal", "part")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    earlier = page.rowsBetween(Window.unboundedPreceding, -1)
    front = rows.where("page_number = 1").withColumn("_begun", F.max(begins.cast("int")).over(so_far)).withColumn("_seen", F.coalesce(F.max(F.col("_level").isNotNull().cast("int")).over(earlier), F.lit(0)))
    front = front.withColumn("level", F.when((F.col("_seen") == 0) | (F.col("_begun") == 1), F.col("_level")))
    other = rows.where("page_number <> 1 or page_number is null").withColumn("level", F.col("_level"))
    keep = ["doc_id", "block_id", "ordinal", "part", "text", "page_number", "bbox", "spans", "level"]
    return front.select(*keep).unionByName(other.select(*keep))


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds parent_id to rows in reading order, document by document: a stack of the open headings, which goes on from batch to batch."""
    doc, opened = None, []
    for batch in batches:
        parents = []
        for d, level, section in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "level", "section_id")), strict=True):
            if d != doc:
                doc, opened = d, []
            parent = None
            if level is not None:
                while opened and opened[-1][0] >= level:
                    opened.pop()
                parent = opened[-1][1] if opened else None
                opened.append((level, section))
            parents.append(parent)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, pa.string())], names=[*batch.schema.names, "parent_id"])


def section_hierarchy(headings: DataFrame) -> DataFrame:
    """Adds section_id and parent_id to blocks in order with a level (null for paragraphs).

    The parent of a heading is the last heading before it with a smaller level, however deep; a paragraph has the section
    of the last heading before it. A document's rows stream through one task, which holds the open headings alone.
    """
    reading = Window.partitionBy("doc_id").orderBy("ordinal", "part")
    so_far = reading.rowsBetween(Window.unboundedPreceding, 0)
    # the window and the sort need what the shuffle before them gives
    rows = headings.repartition("doc_id").withColumn("_n", F.count("level").over(so_far)).withColumn("section_id", F.when(F.col("_n") > 0, F.concat(F.lit("sec_"), F.col("_n")))).drop("_n")
    rows = rows.drop("parent_id").sortWithinPartitions("doc_id", "ordinal", "part")
    return rows.mapInArrow(_parents, StructType([*rows.schema, StructField("parent_id", StringType())]))


def detect_sections(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, content blocks) of raw layout blocks."""
    placed = section_hierarchy(classify(merge_heading_lines(split_inline_headings(raw))))
    sections = placed.where("level is not null").select("doc_id", "section_id", F.col("text").alias("title"), "level", "parent_id")
    kind = F.when(F.col("level").isNull(), F.lit("paragraph")).otherwise(F.lit("heading"))
    return sections, placed.select("doc_id", "block_id", kind.alias("block_type"), "text", "page_number", "section_id", "bbox", "ordinal", "part")
