"""Records of papers from remote services, fetched in batches on the executors. The readers of their formats are in operators.enrichment."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the addresses of a batch to the bodies, None where there is none.
Fetch = Callable[[Sequence[str]], Sequence[str | None]]
# Addresses of the public services.
WORK_BY_DOI, WORKS_BY_TITLE, ENTRY_BY_ARXIV = "https://api.crossref.org/works/{}", "https://api.crossref.org/works?rows=3&query.title={}", "https://export.arxiv.org/api/query?id_list={}"


def over_http(timeout: float = 5.0) -> Fetch:
    """One request after the other; errors and time-outs give None."""

    def fetch(addresses: Sequence[str]) -> list[str | None]:
        out: list[str | None] = []
        for a in addresses:
            try:
                with urllib.request.urlopen(a, timeout=timeout) as answer:
                    out.append(answer.read().decode("utf-8", "replace"))
            except (urllib.error.URLError, TimeoutError, ValueError, OSError):
                out.append(None)
        return out

    return fetch


def fetch_records(keys: DataFrame, key: str, address: str, make: Callable[[], Fetch] = over_http) -> DataFrame:
    """key, body: one request for each different key that isn't null or empty; `make` is called once in each task. Keys without an answer have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = make()
        for batch in batches:
            names = batch.column(0).to_pylist()
            bodies = fetch([address.format(urllib.parse.quote(n, safe="/")) for n in names])
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(list(bodies), pa.string())], names=["key", "body"])

    wanted = keys.select(F.col(key).cast("string").alias("key")).where("key <> ''").distinct()
    return wanted.mapInArrow(run, "key string, body string").where("body is not null").select(F.col("key").alias(key), "body")
