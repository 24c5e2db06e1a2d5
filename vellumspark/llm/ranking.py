"""One ranking from several scores: reciprocal rank fusion with ranks computed without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.tables import cut, written

#: Where a group has more rows than this, groups are ranked in ranges that several tasks share; the result is the same.
PART_ROWS = 100_000


def _in_parts(df: DataFrame, order: Sequence[Column], group: str, weight: Column) -> DataFrame:
    """df with _before: the sum of `weight` over the rows of the group that come before a row. Rows are cut into ranges of (group, order), whatever the groups' sizes; sums of ranges give their offsets."""
    ranged = written(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(group, "_part").agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = totals.select(group, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_here", F.coalesce(F.sum(weight).over(within), F.lit(0))).join(offsets, [group, "_part"]).withColumn("_before", F.col("_offset") + F.col("_here")).drop("_part", "_offset", "_here")


def distributed_rank(df: DataFrame, group: str, value: str, rank: str) -> DataFrame:
    """group, value, rank: 1 + the number of rows of the group with a greater value, for every distinct non-null value.

    Equal values are counted together before anything is ordered.
    """
    distinct = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_rows"))
    return _in_parts(distinct, [F.col(value).desc()], group, F.col("_rows")).select(group, value, (F.col("_before") + 1).alias(rank))


def _fused(named: Sequence[str], k: int) -> Column:
    """Sums of the same terms in another order may differ in the last digits: rounding makes them equal before ties are looked at."""
    total = F.lit(0.0)
    for s in named:
        total = total + F.coalesce(1.0 / (F.lit(float(k)) + F.col(f"{s}_rank")), F.lit(0.0))
    return F.round(total, 12)


def _within_groups(rows: DataFrame, named: Sequence[str], k: int) -> DataFrame:
    """Every group fits in a task: one shuffle by group, then windows."""
    group = Window.partitionBy("_g")
    filled = rows.select("_was", "_g", "_i", *[F.coalesce(F.col(s), F.min(s).over(group)).alias(s) for s in named])
    ranked = filled.select("_was", "_g", "_i", *[F.when(F.col(s).isNotNull(), F.rank().over(group.orderBy(F.col(s).desc()))).alias(f"{s}_rank") for s in named])
    out = ranked.select("_was", "_g", "_i", _fused(named, k).alias("fused"))
    return out.withColumn("position", F.row_number().over(group.orderBy(F.col("fused").desc(), "_i")))


def _across_tasks(rows: DataFrame, named: Sequence[str], k: int) -> DataFrame:
    """Some group is too large for one task: ranks and positions come from sums over ranges, ties included."""
    lowest = rows.groupBy("_g").agg(*[F.min(s).alias(f"{s}_low") for s in named])
    filled = cut(rows.join(lowest, "_g").select("_was", "_g", "_i", *[F.coalesce(s, f"{s}_low").alias(s) for s in named]))
    out = filled
    for s in named:
        out = out.join(distributed_rank(filled, "_g", s, f"{s}_rank"), ["_g", s], "left")
    out = out.select("_was", "_g", "_i", _fused(named, k).alias("fused"))
    return _in_parts(out, [F.col("fused").desc(), F.col("_i")], "_g", F.lit(1)).withColumn("position", F.col("_before") + 1)


def _usable(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def fuse_scores(df: DataFrame, group: str, item: str, scores: Sequence[str], k: int = 60, part_rows: int = PART_ROWS) -> DataFrame:
    """group, item, fused, position: one order of the items of each group, in which each score has the same say.

    Items are ranked by each score alone (equal scores share the better rank), so units, spread and outliers are gone;
    `fused` sums 1 / (k + rank), and `position` orders by fused, then item. Null and NaN count as the lowest score of that
    kind in the group; a score that no item of the group has is left out. At most one row for each (group, item); a null
    group is a group; rows with a null item are left out. Columns of other names are ignored.
    """
    # the group's null is kept apart by a flag so that plain joins do
    rows = df.where(F.col(item).isNotNull()).select(
        F.col(group).alias("_was"), F.concat(F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("_g"), F.col(item).alias("_i"), *[_usable(F.col(s).cast("double")).alias(f"_s{n}") for n, s in enumerate(scores)]
    )
    named = [f"_s{n}" for n in range(len(scores))]
    largest = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= part_rows:
        order = _within_groups(rows, named, k)
    else:
        order = _across_tasks(cut(rows), named, k)
    return order.select(F.col("_was").alias(group), F.col("_i").alias(item), "fused", "position")
