"""Scored results on a stream: the last occurrence of an id wins, across
micro-batches and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.confidence import last_by_id

BATCH = "batch_id"


def stream_last_by_id(scored: DataFrame, out: str, checkpoint: str, id_col: str = "id", ord_col: str = "ord",
                      value_cols: list[str] | None = None) -> None:
    """Drain a stream of ``(id, ord, values...)`` into the table ``out``.

    The state keeps one row per id, its occurrence with the highest ``ord``
    (merged before the shuffle), and every micro-batch hands out the ids that
    it touched.  They are written to a folder of the batch's own number, which
    a replay of the batch overwrites, so replaying changes nothing.  A later
    run with the same ``checkpoint`` goes on where the last one stopped."""
    if not scored.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    values = value_cols or [c for c in scored.columns if c not in (id_col, ord_col)]
    packed = F.max_by(F.struct(*[F.col(c) for c in values]), F.col(ord_col)).alias("__v")
    last = scored.groupBy(id_col).agg(F.max(ord_col).alias(ord_col), packed)
    flat = last.select(id_col, ord_col, *[F.col(f"__v.{c}").alias(c) for c in values])

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{BATCH}={number}")

    query = flat.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(commit).start()
    query.awaitTermination()


def read_last(spark: SparkSession, out: str, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """The table as it stands: of each id the row with the highest ``ord``
    among the batches that touched it."""
    rows = spark.read.parquet(out).drop(BATCH)
    return last_by_id(rows, id_col, ord_col, [c for c in rows.columns if c != id_col])
