"""Occurrences and records of every term, by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that a task counts before it hands its sums on.
FLUSH_TERMS = 200_000


def _counters(token_column: str, flush: int):
    """Each term's counter holds occurrences, records and the record it was last seen in; no set of records is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        record = 0

        def handed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], names=["term", "occurrences", "records"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(batch.schema.get_field_index(token_column)).to_pylist():
                record += 1
                for term in text or ():
                    counter = seen.get(term)
                    if counter is None:
                        seen[term] = [1, 1, record]
                    else:
                        counter[0] += 1
                        if counter[2] != record:
                            counter[1] += 1
                            counter[2] = record
                if len(seen) >= flush:  # between records only, so that no record counts twice
                    yield handed()
        if seen:
            yield handed()

    return run


def term_frequencies(df: DataFrame, terms: str, rare_records: int = 1, common_share: float = 0.6, flush: int = FLUSH_TERMS) -> DataFrame:
    """term, occurrences, records, mark: `terms` is an array column, one row a record.

    mark is 'rare' for a term of at most `rare_records` records, 'common' for one in more than `common_share` of all
    records (records without terms count in the total; one that is both is 'rare'), else null. Null arrays and null terms
    hold nothing; an empty table gives no rows; repeated rows are records of their own.

    The tokens of a record lie together and in order, so counters over them give for each task the occurrences and
    records of its terms. These sums, not the tokens, are partitioned by term and added: no record is in two tasks.
    """
    part = df.select(F.filter(terms, lambda t: t.isNotNull()).alias("_terms")).mapInArrow(_counters("_terms", flush), "term string, occurrences long, records long")
    sums = part.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    mark = F.when(F.col("records") <= rare_records, F.lit("rare")).when(F.col("records") > F.col("_total") * common_share, F.lit("common"))
    return sums.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
