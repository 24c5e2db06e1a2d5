"""Most similar vectors of every vector, by multiprobe p-stable hashing with exact reranking.

A table hashes a unit vector x by `functions` functions floor((a . x + b) / width), a normal, b uniform. A vector lies in
its own bucket of each table and looks into that bucket and into the `probes` perturbed ones that a close vector is most
likely to lie in: each perturbation of one function by one costs the squared distance to that cell wall, and sets of
perturbations are visited in the order of their sums. Pairs that meet are first held against each other by signs of
SKETCH_BITS random projections, which travel with the buckets, then by those of MARK_BITS others, and what is left by the
exact cosine: whole vectors are only moved for pairs that are nearly certain.

Copies of a vector are one class: only its first member is hashed, and no more than k + 1 members ever appear in a list,
so a vector that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vellumspark.tables import cut, measured, observed, release, written

#: Bits of the sketch that travels with buckets, and of the longer one that is looked up for the pairs that it leaves.
SKETCH_BITS, MARK_BITS = 192, 256
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
ROWS_AT_ONCE = 2_000
#: Part of the pairs at the least cosine that the tables bring together, whatever the number of vectors.
RECALL = 0.99
#: Tables whose buckets are shuffled at once; further ones follow when the pairs of these are written, so disk doesn't grow with tables.
TABLES_AT_ONCE = 3
#: Rows of a bucket beyond which its pairs are not written: parts of it are compared in blocks, and each part gives a vector's k nearest alone.
HOT_ROWS = 2_000
#: Rows of a block of a scan.
BLOCK_ROWS = 50_000
#: Cosine from which the tables look for neighbours where none is asked for.
NEAR = 0.9
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


@dataclass(frozen=True)
class Hashing:
    """The tables. Functions grow with the logarithm of the number of vectors, so that a bucket stays small, and tables with functions, so that recall stays the same."""

    dimensions: int = 64
    tables: int = 6
    functions: int = 12
    width: float = 2.0
    probes: int = 6
    seed: int = 7

    @staticmethod
    def for_size(n: int, dimensions: int = 64, min_cosine: float = 0.9) -> Hashing:
        """Two vectors at random agree in a function with a chance of about 0.49: 12 functions for 100 000 vectors, one more for each 2.05 times as many. As many tables as RECALL takes at `min_cosine`."""
        h = Hashing(dimensions=dimensions, functions=max(8, min(32, round(12 + math.log(max(n, 1) / 100_000) / math.log(2.05)))))
        one = meeting(h, min_cosine)
        return replace(h, tables=1 if one >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - one)))

    def groups(self) -> list[Hashing]:
        """The same tables in groups of at most TABLES_AT_ONCE."""
        count = math.ceil(self.tables / TABLES_AT_ONCE)
        return [replace(self, tables=(self.tables + i) // count, seed=self.seed + 1_000 * i) for i in range(count)]


def perturbations(functions: int, lowest: int = 8, largest: int = 4) -> list[tuple[int, ...]]:
    """Sets of places among a vector's `lowest` cheapest perturbations, of up to `largest` members."""
    return [s for size in range(1, largest + 1) for s in combinations(range(min(lowest, 2 * functions)), size)]


class _Tables:
    def __init__(self, h: Hashing):
        rng = np.random.default_rng(h.seed)
        self.h = h
        self.a = rng.normal(size=(h.dimensions, h.tables * h.functions)).astype(np.float32)
        self.b = rng.uniform(0, h.width, h.tables * h.functions).astype(np.float32)
        self.factors = rng.integers(1, 2**63, size=(h.tables, h.functions), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 2**63, size=h.tables, dtype=np.int64).astype(np.uint64)
        self.signs = rng.normal(size=(h.dimensions, SKETCH_BITS)).astype(np.float32)
        self.sets = perturbations(h.functions)
        lowest = min(8, 2 * h.functions)
        self.member = np.zeros((lowest, len(self.sets)), np.float32)
        for j, s in enumerate(self.sets):
            self.member[list(s), j] = 1

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own bucket of each table, the probed ones with the most promising first, and the sketch, of unit rows."""
        h, n = self.h, len(x)
        place = ((x @ self.a + self.b) / np.float32(h.width)).reshape(n, h.tables, h.functions)
        cell = np.floor(place)
        inside = place - cell
        own = (cell.astype(np.int64).astype(np.uint64) * self.factors).sum(2) + self.offsets
        cost = np.concatenate([inside**2, (1 - inside) ** 2], axis=2)  # one down, one up
        low = np.argsort(cost, axis=2)[:, :, : len(self.member)]
        sums = np.take_along_axis(cost, low, axis=2) @ self.member
        best = np.argpartition(sums, h.probes, axis=2)[:, :, : h.probes]
        factors = np.broadcast_to(np.concatenate([np.uint64(0) - self.factors, self.factors], axis=1), cost.shape)
        delta = np.take_along_axis(factors, low, axis=2)
        shift = np.zeros(best.shape, np.uint64)
        chosen = self.member.T[best].astype(np.uint64)  # n, tables, probes, lowest
        for i in range(len(self.member)):
            shift += chosen[:, :, :, i] * delta[:, :, None, i]
        probed = own[:, :, None] + shift
        bits = np.packbits(x @ self.signs > 0, axis=1).view(np.int64)
        return own.view(np.int64), probed.reshape(n, -1).view(np.int64), bits


def met_in(h: Hashing, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of unit rows and each table, whether one of the two looks into the bucket of the other."""
    (ox, px, _), (oy, py, _) = (_Tables(h).buckets(v.astype(np.float32)) for v in (x, y))
    px, py = (p.reshape(*ox.shape, h.probes) for p in (px, py))
    return (ox == oy) | (px == oy[:, :, None]).any(2) | (py == ox[:, :, None]).any(2)


def pairs_at(cosine: float, n: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in n pairs of one cosine, of any direction."""
    x, side = np.random.default_rng(seed).normal(size=(2, n, dimensions))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side -= (side * x).sum(1)[:, None] * x
    side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * side


@lru_cache
def meeting(h: Hashing, cosine: float) -> float:
    """Chance that a pair of this cosine meets in one table: p-stable collisions with probes have no closed form, so 2 000 pairs in 16 tables tell it."""
    found = float(met_in(replace(h, tables=16, seed=h.seed + 1), *pairs_at(cosine, 2_000, h.dimensions, 1)).mean())
    if not found:
        raise ValueError(f"pairs of cosine {cosine} hardly ever meet in tables of {h.functions} functions: use search")
    return found


def _unit_rows(dimensions: int):
    """id, class (of equal unit vectors), unit, marks of the rows whose vector has `dimensions` finite numbers that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.random.default_rng(11).normal(size=(dimensions, MARK_BITS))
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sized = np.array(pc.fill_null(pc.equal(pc.list_value_length(vectors), dimensions), False))
            at = np.flatnonzero(sized)
            flat = vectors.take(pa.array(at)).flatten()
            x = np.array(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), dimensions)  # null numbers become NaN
            largest = np.abs(x).max(axis=1, initial=0)
            with np.errstate(invalid="ignore"):
                good = np.isfinite(x).all(axis=1) & (largest > 0)
            at, x = at[good], x[good] / largest[good][:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            rounded = (np.round(x, 6) + 0.0).astype(np.float32)
            keys = [xxhash.xxh3_128_digest(r.tobytes()) for r in rounded]
            unit = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dimensions), pa.int32()), pa.array(x.astype(np.float32).ravel(), pa.float32()))
            marks = np.packbits(x @ signs > 0, axis=1).view(np.int64)
            wide = MARK_BITS // 64
            marks = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * wide + 1, wide), pa.int32()), pa.array(np.ascontiguousarray(marks).ravel(), pa.int64()))
            yield pa.record_batch([ids.take(pa.array(at)), pa.array(keys, pa.binary()), unit, marks], names=["id", "class", "unit", "marks"])

    return run


def _hashed(h: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(h)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, h.dimensions)
                lists = []
                own, probed, bits = tables.buckets(x)
                for m in (own, probed):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), pa.int64())))
                yield pa.record_batch([part.column(0), *lists, *[pa.array(b, pa.int64()) for b in bits.T]], names=["id", "own", "probed", *SKETCH])

    return run


def hamming_limit(min_cosine: float, bits: int = SKETCH_BITS, deviations: float = 5) -> int:
    """Sketches of vectors with this cosine differ in no more places, but for a chance of about one in a million (of a pair of just this cosine)."""
    p = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _units(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    schema = f"id {dict(df.dtypes)[key]}, class binary, unit array<float>, marks array<long>"
    return written(df.where(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<float>")).mapInArrow(_unit_rows(dimensions), schema))


def _met(reps: DataFrame, h: Hashing, kind: str, min_cosine: float, k: int, hot_rows: int) -> DataFrame:
    """a, b: the pairs that meet in a table and whose sketches are near; of a bucket of more than `hot_rows` vectors only the k nearest of each in each part."""
    # not kept: the hashes of a vector take more room than the vector, and less time to make again than to write and read
    hashed = reps.mapInArrow(_hashed(h), f"id {kind}, own array<long>, probed array<long>, " + ", ".join(f"{c} long" for c in SKETCH))
    lying = hashed.select(F.explode("own").alias("bucket"), F.col("id").alias("b"), *[F.col(c).alias(f"t_{c}") for c in SKETCH])
    lying = lying.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket")))  # in the join's own order: no further shuffle or sort
    looking = hashed.select(F.explode(F.concat("own", "probed")).alias("bucket"), F.col("id").alias("a"), *SKETCH)
    apart = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"t_{c}"))) for c in SKETCH])
    seen = Observation()
    watched = lying.observe(seen, F.count_if(F.col("n") > hot_rows).alias("hot"))
    met = looking.join(watched.where(F.col("n") <= hot_rows), "bucket").where((F.col("a") != F.col("b")) & (apart <= hamming_limit(min_cosine)))
    met = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not observed(seen, lambda: {"hot": lying.where(F.col("n") > hot_rows).count()})["hot"]:
        return met
    hot = lying.where(F.col("n") > hot_rows).select("bucket", "b", F.ceil(F.col("n") / hot_rows).alias("parts"))
    place = lambda c: F.pmod(F.xxhash64(c), "parts")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    rows = hot.join(reps, F.col("b") == F.col("id")).select("id", "unit", "bucket", place("id").alias("part"), every.alias("side"))
    asking = looking.select("bucket", "a").join(hot.select("bucket", "parts").distinct(), "bucket").join(reps, F.col("a") == F.col("id")).select("id", "unit", "bucket", place("id").alias("side"), every.alias("part"))
    group = ["bucket", "part", "side"]
    near = rows.groupBy(*group).cogroup(asking.groupBy(*group)).applyInArrow(_best_in_part(k, h.dimensions, ARROW[kind]), f"id {kind}, neighbour {kind}, cosine double")
    near = near.where(F.col("cosine") >= min_cosine).select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
    return met.unionByName(written(near.distinct()))


def _near(reps: DataFrame, marks: DataFrame, h: Hashing, kind: str, k: int, min_cosine: float, hot_rows: int) -> DataFrame:
    """a, b, cosine: the pairs of `min_cosine` or more that the tables bring together, or a common neighbour."""
    found = []
    for group in h.groups():
        if found:
            release(reps.sparkSession)
        found.append(_met(reps, group, kind, min_cosine, k, hot_rows))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    own = lambda n, m: marks.select(F.col("id").alias(n), F.col("marks").alias(m))
    differ = F.aggregate(F.zip_with("m", "n", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    pairs = pairs.join(own("a", "m"), "a").join(own("b", "n"), "b").select("a", "b", differ.alias("d")).where(F.col("d") <= hamming_limit(min_cosine, MARK_BITS, 6))
    pairs = written(pairs)  # few are left
    # what the tables have missed is mostly near a common neighbour: each vector looks at the k best of its k best
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("n") <= k).select("a", "b")
    second = best.select(F.col("b").alias("c"), "a").join(best.select(F.col("a").alias("c"), "b"), "c").where(F.col("a") < F.col("b")).select("a", "b")
    pairs = written(pairs.select("a", "b").unionByName(second).distinct())
    # only the vectors that are in a pair are moved; where pairs are few, as Spark sees by the table's size, no other is read twice
    wanted = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    units = written(reps.join(wanted, "id", "left_semi"))
    first = pairs.join(units, F.col("a") == F.col("id")).select("a", "b", F.col("unit").alias("u"))
    exact = first.join(units, F.col("b") == F.col("id")).select("a", "b", _cosine(F.col("u"), F.col("unit")).alias("cosine")).where(F.col("cosine") >= min_cosine)
    exact = cut(exact)
    return exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))


def _scanned(reps: DataFrame, n: int, asked: DataFrame, asking: int, kind: str, k: int, dimensions: int, block_rows: int) -> DataFrame:
    """a, b, cosine: the k nearest of each asked vector among all, by products of blocks; no pair but a block's k best leaves its task."""
    across, down = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asking / block_rows))
    place = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    rows = reps.select("id", "unit", place(across).alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))).alias("y"))
    queries = asked.select("id", "unit", place(down).alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))).alias("x"))
    best = rows.groupBy("x", "y").cogroup(queries.groupBy("x", "y")).applyInArrow(_best_in_part(k, dimensions, ARROW[kind]), f"id {kind}, neighbour {kind}, cosine double")
    return best.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), "cosine")


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, min_cosine: float | None = None, dimensions: int = 64, hashing: Callable[[int], Hashing] | None = None, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, neighbour, cosine, rank: for each usable vector the k others of greatest cosine, or those among them of at least `min_cosine`.

    Usable is a vector of `dimensions` finite numbers that are not all zero; rows with other vectors or a null key have no
    neighbours and are none. At most one row for each key. Equal cosines are ordered by key. Vectors whose unit vectors
    agree in six decimals are copies, with a cosine of 1. Other columns are ignored; an empty table gives no rows.

    The tables find the pairs of a cosine of at least `min_cosine` (NEAR if it is None): a pair is found if either of the
    two looks into a bucket of the other, which 99 in 100 pairs of that very cosine do whatever the number of vectors, and
    nearly all of greater cosine, or if a near neighbour of the one is one of the other (held against brute force in the
    tests). Without `min_cosine` a vector that
    has fewer than k such neighbours gets its k from products with all others in blocks, exactly: its neighbours are
    hardly nearer than the rest, and tables that find them visit most of the rows. That part grows with the number of
    such vectors times all.
    """
    kind = dict(df.dtypes)[key]
    least = NEAR if min_cosine is None else min_cosine
    units = _units(df, key, vector, dimensions)
    place = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    placed = written(units.select("id", "class").withColumn("n", place))
    firsts = placed.where(F.col("n") <= k + 1)
    heads = firsts.where("n = 1").select("id", F.col("class").alias("_class"))
    # copies are taken away, not heads picked out: where they are few, as Spark sees by the table's size, no vector is shuffled
    copies = written(placed.where("n > 1").select("id"))
    # written: each group of tables reads them again
    reps, seen = measured(units.join(copies, "id", "left_anti").select("id", "unit"), n=F.count(F.lit(1)))
    h = (hashing or (lambda n: Hashing.for_size(n, dimensions, least)))(seen["n"])
    both = _near(reps, units, h, kind, k, least, hot_rows)
    # classes: the members that a list can need, the class's own ones first
    members = firsts.join(heads.select(F.col("id").alias("head"), F.col("_class").alias("class")), "class").select("head", "id")
    if min_cosine is None:
        own_size = members.groupBy(F.col("head").alias("a")).agg((F.count(F.lit(1)) - 1).alias("n"))
        close = both.select("a", F.lit(1).alias("n")).unionByName(own_size).groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
        short, asking = measured(reps.join(close.select(F.col("a").alias("id")), "id", "left_anti"), n=F.count(F.lit(1)))
        far = _scanned(reps, seen["n"], short, asking["n"], kind, k, dimensions, block_rows)
        both = both.join(close.select("a"), "a", "left_semi").unionByName(far)
    own = members.select(F.col("head").alias("a"), F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    others = both.join(members.select(F.col("head").alias("b"), F.col("id").alias("neighbour")), "b").select("a", "neighbour", "cosine")
    order = [F.col("cosine").desc(), F.col("neighbour")]
    lists = own.unionByName(others).withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("n") <= k + 1)
    # most lists of near vectors hold their own vector alone
    lists = lists.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("a"))).where("_size > 1").drop("n", "_size")
    everyone = placed.select("id", "class").join(heads.select(F.col("id").alias("a"), F.col("_class").alias("class")), "class").select("id", "a")
    out = everyone.join(lists, "a").where(F.col("id") != F.col("neighbour"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(key), "neighbour", F.round(F.least("cosine", F.lit(1.0)), 6).alias("cosine"), "rank")


@dataclass(frozen=True)
class Cells:
    """One table of wide cells for searches that must also find distant neighbours; offsets up to `reach` cells either way are visited, the likeliest `visits` of them."""

    dimensions: int = 64
    functions: int = 4
    width: float = 1.5
    reach: int = 2
    visits: int = 110
    seed: int = 7

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        place = (x @ rng.normal(size=(self.dimensions, self.functions)) + rng.uniform(0, self.width, self.functions)) / self.width
        return np.floor(place).astype(np.int64), place - np.floor(place)

    @staticmethod
    def codes(cells: np.ndarray) -> np.ndarray:
        """Cells as numbers, for coordinates from -32 to 31 (a unit vector's projection doesn't come near these)."""
        return ((np.clip(cells, -32, 31) + 32) * (64 ** np.arange(cells.shape[-1]))).sum(-1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Codes of the cells that each row visits: those with the smallest sum of squared distances to their walls."""
        cell, inside = self.places(x)
        offsets = np.array(list(product(range(-self.reach, self.reach + 1), repeat=self.functions)))
        far = np.abs(offsets)[None] - np.where(offsets[None] > 0, inside[:, None, :], 1 - inside[:, None, :])
        cost = np.where(offsets[None] == 0, 0.0, far**2).sum(2)
        best = np.argpartition(cost, min(self.visits, len(offsets)) - 1, axis=1)[:, : self.visits]
        return self.codes(cell[:, None, :] + offsets[best])


def _celled(c: Cells, visit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.dimensions).astype(np.float64)
                codes = c.visited(x) if visit else c.codes(c.places(x)[0])[:, None]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel(), pa.int64()))
                yield pa.record_batch([*part.columns, cells], names=["id", "unit", "cells"])

    return run


def _best_in_part(k: int, dimensions: int, ids: pa.DataType):
    """The k nearest rows of one part for each query that comes to it, by blocks of products."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        asked, found, cosines = [], [], []
        if rows.num_rows and queries.num_rows:
            matrix = lambda t: t.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            x, names = matrix(rows), np.array(rows.column("id").to_pylist(), dtype=object)
            q, who = matrix(queries), queries.column("id").to_pylist()
            take = min(k + 1, len(x))
            # a bound for the last place of each query, from the first rows: hardly any other row gets past it
            some = max(take, min(len(x), len(x) // 8))
            for start in range(0, len(q), 256):
                near = q[start : start + 256] @ x.T
                least = np.partition(near[:, :some], some - take, axis=1)[:, some - take]
                at_row, at = np.nonzero(near >= least[:, None] - 1e-6)  # all that tie with the last one, and what rounding may have hidden
                for i, part in enumerate(np.split(at, np.searchsorted(at_row, np.arange(1, len(near))))):
                    values = near[i, part]
                    if len(part) > take:
                        part = part[values >= np.partition(values, len(part) - take)[len(part) - take] - 1e-6]
                    exact = np.round(x[part].astype(np.float64) @ q[start + i].astype(np.float64), 6)
                    me = who[start + i]
                    best = sorted((-c, n) for c, n in zip(exact.tolist(), names[part].tolist(), strict=True) if n != me)[:k]
                    asked += [me] * len(best)
                    found += [n for _, n in best]
                    cosines += [-c for c, _ in best]
        return pa.table([pa.array(asked, ids), pa.array(found, ids), pa.array(cosines, pa.float64())], names=["id", "neighbour", "cosine"])

    return run


def search(df: DataFrame, key: str, vector: str, asked: Column, k: int = 10, cells: Cells = Cells(), part_rows: int = 100_000) -> DataFrame:
    """key, neighbour, cosine, rank: for each usable vector that `asked` (a condition on the key) chooses, the k others of greatest cosine among the cells that it visits.

    For neighbours at any distance. Rows lie in one cell each, in parts of about `part_rows`; a query's vector goes to the
    parts of the cells that it visits, nothing else is moved twice. Ties go by key. On vectors that are noise the standard
    cells find more than nine in ten of the ten nearest and look at about three quarters of all rows: nothing less does
    there, as the nearest are hardly nearer than the rest.
    """
    kind = dict(df.dtypes)[key]
    units = _units(df, key, vector, cells.dimensions).select("id", "unit")
    schema = f"id {kind}, unit array<float>, cells array<long>"
    lying = units.mapInArrow(_celled(cells, False), schema).select("id", "unit", F.get("cells", F.lit(0)).alias("cell"))
    # cells are few: 64 ** functions at the very most, and as many as the projections of unit vectors reach in fact
    parts = cut(lying.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts")))
    rows = lying.join(F.broadcast(parts), "cell").select("id", "unit", "cell", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    wanted = units.join(df.where(asked).select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    looking = wanted.mapInArrow(_celled(cells, True), schema).select("id", "unit", F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell")
    looking = looking.select("id", "unit", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    best = rows.groupBy("cell", "part").cogroup(looking.groupBy("cell", "part")).applyInArrow(_best_in_part(k, cells.dimensions, ARROW[kind]), f"id {kind}, neighbour {kind}, cosine double")
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias(key), "neighbour", "cosine", "rank")
