import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm.neighbours import Hashing, hamming_limit, meeting, met_in, nearest, pairs_at, perturbations, search


def test_recall_and_exactness_on_noise_with_planted_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    near = x[:400] / np.linalg.norm(x[:400], axis=1)[:, None]
    side = rng.normal(size=(400, 64))
    side -= (side * near).sum(1)[:, None] * near
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.9, 1.0, 400)[:, None]
    x = np.concatenate([x, (cos * near + np.sqrt(1 - cos**2) * side) * rng.uniform(0.1, 40, (400, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "id bigint, v array<float>, rank int").repartition(6)
    got = {(r.id, r.neighbour): r.cosine for r in nearest(df, "id", "v", min_cosine=0.9).collect()}
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -1)
    want = {(int(i), int(j)) for i, j in zip(*np.where(s >= 0.9), strict=True)}
    assert len(want & got.keys()) >= 0.99 * len(want)
    for (i, j), c in got.items():
        assert c == pytest.approx(s[i, j], abs=2e-6) and (j, i) in got
    # without a least cosine: ten neighbours of every vector, none nearer is missed
    full = {}
    for r in nearest(df, "id", "v", block_rows=900).collect():
        full.setdefault(r.id, {})[r.neighbour] = (r.cosine, r.rank)
    assert set(full) == set(range(len(x)))
    for i, near in full.items():
        assert sorted(r for _, r in near.values()) == list(range(1, 11))
        best = np.sort(s[i])[::-1][:10]
        assert np.allclose(sorted((c for c, _ in near.values()), reverse=True), best, atol=2e-6)


def test_a_hot_bucket_of_near_but_unequal_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([1 + 0.002 * rng.normal(size=(400, 64)), rng.normal(size=(200, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -1)
    got = {}
    for r in nearest(df, "id", "v", k=5, min_cosine=0.9, hot_rows=50).collect():
        got.setdefault(r.id, []).append(r.cosine)
    assert set(got) == set(range(400))
    for i, near in got.items():
        assert np.allclose(sorted(near, reverse=True), np.sort(s[i])[::-1][:5], atol=2e-6)


def test_copies_ties_and_unusable_vectors(spark):
    base = [1.0] + [0.5] * 63
    rows = [(i, base) for i in range(30)] + [(100, [2 * v for v in base]), (50, [0.0] * 64), (51, None), (52, []), (53, base[:63]), (54, [math.nan] + base[1:]), (55, [math.inf] + base[1:]), (56, [None] + base[1:]), (57, [-v for v in base]), (None, base)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {}
    for r in nearest(df, "id", "v", k=10).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got[0] == list(range(1, 11)) and got[5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10] and got[100] == list(range(10))
    assert set(got) == {*range(30), 57, 100} and got[57] == list(range(10))
    assert nearest(df.limit(0), "id", "v").count() == 0


def test_parts():
    assert perturbations(2, lowest=3, largest=2) == [(0,), (1,), (2,), (0, 1), (0, 2), (1, 2)]
    assert hamming_limit(1.0) == 0 and hamming_limit(0.9, 128) == 39 and hamming_limit(0.9) == 52
    assert Hashing.for_size(100_000).functions == 12 and Hashing.for_size(10**9).functions > 17


def test_extra_columns_of_the_result_s_names(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64)], "id bigint, v array<float>")
    for c in ("neighbour", "cosine", "rank", "class", "unit", "bucket", "a", "b"):
        df = df.withColumn(c, F.lit("x"))
    assert nearest(df, "id", "v").count() == 2


@pytest.mark.parametrize("part_rows", [150, 100_000])
def test_search_recall_on_noise(spark, part_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(-50, None, "x")], "id bigint, v array<float>, cell string")
    got = {}
    for r in search(df, "id", "v", F.col("id") % 50 == 0, part_rows=part_rows).collect():
        got.setdefault(r.id, {})[r.neighbour] = (r.cosine, r.rank)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    assert set(got) == set(range(0, 2500, 50))
    hits = sum(int(n) in got[i] for i in got for n in np.argsort(-s[i])[:10])
    assert hits >= 0.9 * 10 * len(got)
    assert all(c == pytest.approx(s[i, n], abs=2e-6) for i, near in got.items() for n, (c, _) in near.items())
    assert all(sorted(r for _, r in near.values()) == list(range(1, 11)) for near in got.values())


def test_search_among_copies_and_nothing(spark):
    df = spark.createDataFrame([(i, [1.0] + [0.5] * 63) for i in range(40)], "id bigint, v array<double>")
    got = [r.neighbour for r in search(df, "id", "v", F.col("id") == 3, k=5, part_rows=7).orderBy("rank").collect()]
    assert got == [0, 1, 2, 4, 5]
    assert search(df.limit(0), "id", "v", F.col("id") == 3).count() == 0


@pytest.mark.parametrize("n, functions", [(14_000, 9), (147_000, 13), (1_470_000, 16), (15_000_000, 19)])
def test_recall_at_the_least_cosine_does_not_fall_with_size(n, functions):
    h = Hashing.for_size(n)
    x, y = pairs_at(0.9, 1_500, 64, 8)
    found = np.zeros(len(x), bool)
    for group in h.groups():
        found |= met_in(group, x, y).any(1)
    assert h.functions == functions and found.mean() >= 0.98
    assert sum(g.tables for g in h.groups()) == h.tables and len({g.seed for g in h.groups()}) == len(h.groups())
    assert all(g.tables <= 3 for g in h.groups())


@pytest.mark.parametrize("n", [147_000])
def test_borderline_pairs_are_found_with_the_tables_of_large_sizes(spark, n):
    x, y = pairs_at(0.902, 600, 64, 9)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, y]))]
    got = {(r.id, r.neighbour) for r in nearest(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v", min_cosine=0.9, hashing=lambda _: Hashing.for_size(n)).collect()}
    assert sum((i, i + 600) in got and (i + 600, i) in got for i in range(600)) >= 0.975 * 600


def test_a_pair_that_no_table_brings_together_is_found_by_a_common_neighbour(spark):
    rng = np.random.default_rng(6)
    x, y = pairs_at(0.93, 300, 64, 5)
    middle = x + y  # near to both
    near = (x * middle).sum(1) / np.linalg.norm(middle, axis=1)
    assert near.min() > 0.98
    rows = np.concatenate([x, y, middle, rng.normal(size=(500, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id bigint, v array<double>")
    few = lambda _: Hashing(tables=3, functions=13)
    got = {(r.id, r.neighbour) for r in nearest(df, "id", "v", min_cosine=0.9, hashing=few).collect()}
    linked = [i for i in range(300) if (i, 600 + i) in got and (300 + i, 600 + i) in got]
    assert len(linked) > 200 and all((i, 300 + i) in got for i in linked)
    assert met_in(few(0), x, y).any(1).mean() < 0.97


def test_tables_follow_the_least_cosine():
    assert Hashing.for_size(10**6, min_cosine=0.95).tables < Hashing.for_size(10**6).tables
    assert Hashing.for_size(10**6, min_cosine=1.0).tables == 1
    with pytest.raises(ValueError):
        meeting(Hashing(functions=32), 0.0)
