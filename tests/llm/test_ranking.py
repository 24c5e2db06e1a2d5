import math
import random

import pytest
from pyspark.sql import functions as F

from vellumspark.llm.ranking import distributed_rank, fuse_scores

SCHEMA = "q bigint, item string, s1 double, s2 double, s3 double, fused string"


def brute(rows, k=60):
    out = {}
    for q in {r[0] for r in rows}:
        hits = [r for r in rows if r[0] == q and r[1] is not None]
        total = {r[1]: 0.0 for r in hits}
        for n in (2, 3, 4):
            good = [r[n] for r in hits if r[n] is not None and not math.isnan(r[n])]
            if good:
                value = {r[1]: r[n] if r[n] is not None and not math.isnan(r[n]) else min(good) for r in hits}
                for i, v in value.items():
                    total[i] += 1 / (k + 1 + sum(w > v for w in value.values()))
        for p, i in enumerate(sorted(total, key=lambda i: (-round(total[i], 12), i)), 1):
            out[q, i] = (round(total[i], 9), p)
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(q, f"i{i}", rng.choice([None, math.nan, rng.random(), 0.5]), rng.gauss(0, 1e6), None if q == 2 else rng.choice([1.0, 2.0, math.inf])) for q in (1, 2, None) for i in range(30)]
    return [*rows, (3, "lone", None, None, None), (4, None, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("part_rows", [5, 100_000])
def test_fusion_against_brute_force(spark, part_rows):
    rows = rows_of(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {(r.q, r["item"]): (round(r.fused, 9), r.position) for r in fuse_scores(df, "q", "item", ["s1", "s2", "s3"], part_rows=part_rows).collect()}
    assert got == brute(rows)


def test_one_tie_of_a_whole_large_group(spark):
    df = spark.range(300).select(F.lit(7).alias("q"), F.format_string("i%03d", "id").alias("item"), F.lit(1.0).alias("s1"), F.lit(None).cast("double").alias("s2"), F.lit(2.0).alias("s3"))
    got = {r["item"]: r.position for r in fuse_scores(df, "q", "item", ["s1", "s2", "s3"], part_rows=50).collect()}
    assert got == {f"i{i:03d}": i + 1 for i in range(300)}


def test_no_score_wins_by_size_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", 0.1, 1e9, 0.0, ""), (1, "b", 0.2, 1.0, 0.5, ""), (1, "c", 0.15, 2.0, 0.1, "")], SCHEMA)
    order = [r["item"] for r in fuse_scores(df, "q", "item", ["s1", "s2", "s3"]).orderBy("position").collect()]
    assert order[0] == "b"
    assert fuse_scores(df.limit(0), "q", "item", ["s1", "s2", "s3"]).count() == 0


def test_rank_of_a_large_group_in_parts(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(1700)).cast("double").alias("v"))
    values = [r.v for r in df.collect()]
    above = {v: 1 + sum(w > v for w in values) for v in set(values)}
    assert {r.v: r.rank for r in distributed_rank(df, "g", "v", "rank").collect()} == above
