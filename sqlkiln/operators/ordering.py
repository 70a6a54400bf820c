"""Dense positions and sequential batch ids without a single-partition
window.

``dense_positions`` range-partitions by the order key, sorts inside each
partition and tags rows with ``monotonically_increasing_id`` (partition index
in the upper bits, row index in the lower 33 bits).  The tagged frame is
checkpointed so both passes see the same partitioning; per-partition counts
(one row per partition) become prefix offsets that are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

_LOW_BITS = (1 << 33) - 1


def dense_positions(df: DataFrame, ord_col: str = "ord", out: str = "pos", num_partitions: int | None = None) -> DataFrame:
    # Without an explicit count AQE sizes the range partitions from the data.
    ranged = df.repartitionByRange(num_partitions, ord_col) if num_partitions else df.repartitionByRange(ord_col)
    tagged = materialize(ranged.sortWithinPartitions(ord_col).withColumn("__mid", F.monotonically_increasing_id()))
    pid = F.shiftright("__mid", 33)
    counts = tagged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: the prefix sum is over a bounded, tiny table.
    offsets = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off"))
    joined = tagged.join(F.broadcast(offsets), pid == F.col("__pid"))
    return joined.withColumn(out, F.col("__off") + F.col("__mid").bitwiseAND(F.lit(_LOW_BITS))).drop(
        "__mid", "__pid", "__off"
    )


def with_batch_id(df: DataFrame, batch_size: int, ord_col: str = "ord", out: str = "batch_id",
                  num_partitions: int | None = None) -> DataFrame:
    """Sequential batches in ``ord`` order; the last batch may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    pos = dense_positions(df, ord_col, "__pos", num_partitions)
    return pos.withColumn(out, F.expr(f"__pos div {int(batch_size)}")).drop("__pos")
