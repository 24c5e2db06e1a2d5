"""A table of embedded blocks or chunks: upsert, delete, statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.metadata import flatten_metadata
from vellumspark.tables import current_rows, measured


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new`, and those of `old` with other keys. `new` has each key once."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_paper(table: DataFrame, paper_id: str) -> DataFrame:
    """Without the paper's rows; rows without a paper stay."""
    return table.where(~F.coalesce(F.col("paper_id") == paper_id, F.lit(False)))


def deleted_rows(dense: DataFrame, sparse: DataFrame, paper_id: str) -> DataFrame:
    """One row, n: the larger number of rows that deleting a paper takes from the two tables."""
    a = dense.where(F.col("paper_id") == paper_id).agg(F.count(F.lit(1)).alias("_a"))
    b = sparse.where(F.col("paper_id") == paper_id).agg(F.count(F.lit(1)).alias("_b"))
    return a.crossJoin(b).select(F.greatest("_a", "_b").alias("n"))


def indexed_papers(table: DataFrame, title: str = "paper_title") -> DataFrame:
    """paper_id, paper_title, n_blocks, n_pages; a paper without a title is called by its id."""
    return table.groupBy("paper_id").agg(F.coalesce(F.min(title), F.col("paper_id")).alias("paper_title"), F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("page_number").alias("n_pages"))


def collection_stats(table: DataFrame) -> DataFrame:
    """One row: n_blocks, n_papers."""
    return table.agg(F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("paper_id").alias("n_papers"))


def prepare_blocks(blocks: DataFrame, paper_title: str | None = None) -> DataFrame:
    """Embedded blocks as they are stored: metadata without nulls, and the paper's title (a column, else metadata's title, else the paper's id), page and section among them."""
    meta = F.coalesce(flatten_metadata(F.col("metadata")), F.create_map().cast("map<string,string>"))
    title = F.coalesce(F.col(paper_title) if paper_title else F.lit(None).cast("string"), F.element_at(meta, "title"), F.col("paper_id"))
    own = F.map_filter(F.create_map(F.lit("paper_id"), F.col("paper_id"), F.lit("paper_title"), title, F.lit("page_number"), F.col("page_number").cast("string"), F.lit("section_title"), F.nullif("section_title", F.lit(""))), lambda _, v: v.isNotNull())
    rest = F.map_filter(meta, lambda k, _: ~k.isin("paper_id", "paper_title", "page_number", "section_title"))
    return blocks.withColumn("metadata", F.map_concat(rest, own)).withColumn("paper_title", title)


class Collection:
    """A table kept below a folder in buckets by key. A write makes new files for the buckets that it touches and then a manifest that names the files of every bucket; readers see the last complete manifest.

    A lost executor or a stopped write leaves the last state as it was. `keys` identify a row. One writer at a time. Files
    that only manifests older than the last `kept` ones name are removed after a write.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str], buckets: int = 16, kept: int = 2):
        self.spark, self.folder, self.schema, self.keys, self.buckets, self.kept = spark, folder.rstrip("/"), schema, list(keys), buckets, kept

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(f"{self.folder}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _manifest(self, number: int) -> dict[str, str]:
        """Bucket to the folder that holds it."""
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        fs, path = self._fs(f"{self.folder}/manifests/{number}.json")
        stream = fs.open(path)
        try:
            return json.loads(lines.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _state(self) -> tuple[int, dict[str, str]]:
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict[str, str], buckets: Sequence[int] | None = None) -> DataFrame:
        paths = sorted({f"{self.folder}/data/{v}/bucket={k}" for k, v in state.items() if buckets is None or int(k) in buckets})
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._state()[1])

    def _write(self, rows: DataFrame, touched: Sequence[int] | None) -> None:
        """`rows` are all rows of the `touched` buckets (None: of all)."""
        number, state = self._state()
        version = uuid.uuid4().hex
        names = [f.name for f in rows.sparkSession.createDataFrame([], self.schema).schema]
        rows.select(*names).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{version}")
        made = {n.split("=")[1]: version for n in self._names(f"data/{version}") if n.startswith("bucket=")}
        state = {k: v for k, v in state.items() if touched is not None and int(k) not in touched} | made
        fs, path = self._fs(f"{self.folder}/manifests/.{version}")
        stream = fs.create(path)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(path, self._fs(f"{self.folder}/manifests/{number + 1}.json")[1]):
            raise RuntimeError("another writer was faster")
        self._forget()

    def _forget(self) -> None:
        numbers = self._numbers()
        used = {v for n in numbers[-self.kept :] for v in self._manifest(n).values()}
        for n in numbers[: -self.kept]:
            fs, path = self._fs(f"{self.folder}/manifests/{n}.json")
            fs.delete(path, False)
        for v in self._names("data"):
            if v not in used:
                fs, path = self._fs(f"{self.folder}/data/{v}")
                fs.delete(path, True)

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, list[int]]:
        """Rows written once, and the buckets of their keys."""
        rows, seen = measured(rows, buckets=F.collect_set(self._bucket()))
        return rows, sorted(seen["buckets"] or ())

    def upsert(self, rows: DataFrame) -> None:
        """Rows with each key once; of the buckets that hold none of the keys nothing is read or written."""
        rows, touched = self._staged(rows)
        if touched:
            self._write(upsert(self._read(self._state()[1], touched), rows, self.keys), touched)

    def merge(self, rows: DataFrame, ts: str) -> None:
        """Rows with repeated keys; of those and of what is there the latest by `ts` holds."""
        rows, touched = self._staged(current_rows(rows, self.keys, ts))
        if touched:
            old = self._read(self._state()[1], touched)
            self._write(current_rows(old.unionByName(rows.select(*old.columns)), self.keys, ts), touched)

    def remove(self, keys: DataFrame) -> int:
        """Without the rows of these keys; how many there were."""
        keys, touched = self._staged(keys.select(*self.keys).distinct())
        table = self._read(self._state()[1], touched)
        n = table.join(keys, self.keys, "left_semi").count()
        if n:
            self._write(table.join(keys, self.keys, "left_anti"), touched)
        return n

    def delete_paper(self, paper_id: str) -> int:
        return self.remove(self.read().where(F.col("paper_id") == paper_id))

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], self.schema), None)
