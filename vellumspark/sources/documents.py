"""Readers: folders of files with content hashes, PDF layout where a PDF library is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "array<struct<text:string,font_size:double,font:string,flags:int>>"
RAW_BLOCK = f"doc_id string, block_id string, ordinal bigint, text string, page_number int, bbox array<double>, spans {SPANS}"


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, doc_id (SHA-256 of the content), content of the files of a folder that fit the pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("doc_id"), "content")


def read_pdf_blocks(files: DataFrame) -> DataFrame:
    """Raw layout blocks of PDF files (doc_id, content), for operators.layout. Needs PyMuPDF on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs PyMuPDF on the executors") from e
        for frame in frames:
            rows = []
            for doc_id, content in zip(frame.doc_id, frame.content, strict=True):
                with pymupdf.open(stream=bytes(content), filetype="pdf") as pdf:
                    for number, page in enumerate(pdf, 1):
                        for index, block in enumerate(page.get_text("dict")["blocks"]):
                            spans = [{"text": s["text"], "font_size": float(s["size"]), "font": s["font"], "flags": int(s["flags"])} for line in block.get("lines", ()) for s in line["spans"]]
                            text = " ".join(s["text"] for s in spans).strip()
                            if text:
                                rows.append((doc_id, f"page_{number}_block_{index}", number * 100_000 + index, text, number, [float(x) for x in block["bbox"]], spans))
            yield pd.DataFrame(rows, columns=["doc_id", "block_id", "ordinal", "text", "page_number", "bbox", "spans"])

    return files.select("doc_id", "content").mapInPandas(run, RAW_BLOCK)
