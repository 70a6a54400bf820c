"""Ranks and running sums of a table of any size, without a window over a
whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sqlkiln.session import broadcast_if_small, materialize


def _same(left: list[Column], right: list[Column]) -> Column:
    both = F.lit(True)
    for a, b in zip(left, right):
        both = both & a.eqNullSafe(b)
    return both


def running(rows: DataFrame, groups: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``before``, the sum of ``weight`` (None: the count) over
    the rows of its group that come earlier, and ``whole``, the sum over the
    group. Nulls come first; a null group is a group.

    The rows are range-partitioned and sorted, so a hot group spans many
    tasks; what is summed over a group is one row per partition it touches."""
    part, nth, over = "_part", "_nth", [*groups, "_part"]
    dealt = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*groups, *order)])
    dealt = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*groups, *order)])
    dealt = materialize(dealt.withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id()))
    each = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sums = dealt.groupBy(*over).agg(each.cast("long").alias("here"), F.min(nth).alias("first"))
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ahead = F.sum("here").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_of_{c}") for c in over], "first", F.coalesce(ahead, F.lit(0)).alias("ahead"),
                       F.sum("here").over(group).alias("whole"))
    sums = broadcast_if_small(sums)
    met = dealt.join(sums, _same([dealt[c] for c in over], [sums[f"_of_{c}"] for c in over]))
    if weight is None:
        local = F.col(nth) - F.col("first")
    else:
        inside = Window.partitionBy(*over).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)
        local = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return met.withColumn("before", (F.col("ahead") + local).cast("long")).drop(
        part, nth, "first", "ahead", *[f"_of_{c}" for c in over])
