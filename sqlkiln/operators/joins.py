"""Lookups of samples against schema strings and labels.

A missing key is an error in the original (``KeyError``).  Here the strict
mode checks the keys with a left-anti join before the lookup (on a stream,
``raise_error`` fails the first unmatched row), ``drop`` quarantines the row
and ``unmatched`` reports the keys.  With an ``Observation`` in place of the
mode, the lookup itself counts the rows without a match, in the one pass that
writes the result: ``sinks.write_checked`` commits only when there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import DEFAULT_BROADCAST_BYTES, broadcast_if_small
from .catalog import empty_schema_string

ON_MISSING = ("raise", "drop", "keep")


OnMissing = str | Observation


def _strict(df: DataFrame, flag: str, key: str, what: str, on_missing: OnMissing) -> DataFrame:
    if isinstance(on_missing, Observation):
        lacks = F.col(flag).isNull()
        example = F.min(F.when(lacks, F.concat(F.lit(f"{what} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))))
        watched = df.observe(on_missing, F.count_if(lacks).alias("unmatched"), example.alias("example"))
        return watched.filter(F.col(flag).isNotNull()).drop(flag)
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing must be one of {ON_MISSING}")
    if on_missing == "drop":
        return df.filter(F.col(flag).isNotNull()).drop(flag)
    if on_missing == "raise" and df.isStreaming:
        # A stream cannot be checked up front: fail on the first unmatched row.
        check = F.when(
            F.col(flag).isNull(),
            F.raise_error(F.concat(F.lit(f"no {what} for {key} "), F.col(key).cast("string"))),
        ).otherwise(F.lit(True))
        return df.filter(check).drop(flag)
    return df.drop(flag)


def require_matches(samples: DataFrame, dim: DataFrame, key: str, what: str) -> None:
    """Strict lookup: raise ``KeyError`` naming a few unmatched keys.  A
    left-anti join; a lazy in-plan check could be optimised away by a later
    null-rejecting filter."""
    if samples.isStreaming:
        return
    missing = [r[key] for r in unmatched(samples.select(key), dim, key).limit(5).collect()]
    if missing:
        raise KeyError(f"no {what} for {key} {missing}")


def attach_schema(
    samples: DataFrame,
    schemas: DataFrame,
    on_missing: OnMissing = "raise",
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
) -> DataFrame:
    """samples ⋈ schema strings on ``db_id``.  The schema side is
    materialised, measured and broadcast only when small; otherwise the join
    shuffles and AQE splits a hot ``db_id``."""
    dim = broadcast_if_small(schemas.select("db_id", "schema_str", F.lit(True).alias("__hit")), max_broadcast_bytes)
    if on_missing == "raise":
        require_matches(samples, dim, "db_id", "schema string")
    joined = samples.join(dim, "db_id", "left")
    return _strict(joined, "__hit", "db_id", "schema string", on_missing)


def attach_schema_const(samples: DataFrame, schemas: DataFrame, db_id: str) -> DataFrame:
    """One fixed database's schema string on every sample: one row read, one
    literal, no join.  A database absent from the catalog renders as empty
    key lists, as in the original."""
    found = schemas.filter(F.col("db_id") == F.lit(db_id)).select("schema_str").first()
    return samples.withColumn("schema_str", F.lit(found["schema_str"] if found else empty_schema_string()))


def attach_labels(questions: DataFrame, labels: DataFrame, on_missing: OnMissing = "raise") -> DataFrame:
    """questions ⋈ labels on ``id`` (both phases need the label to exist).
    Labels are one row per id, as large as the corpus: a shuffle join, no
    broadcast.  Tables written with ``write_copartitioned`` join without one
    either."""
    dim = labels.select("id", "sql", F.lit(True).alias("__hit"))
    if on_missing == "raise":
        require_matches(questions, dim, "id", "label")
    joined = questions.join(dim, "id", "left")
    return _strict(joined, "__hit", "id", "label", on_missing)


def unmatched(samples: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Sample rows whose ``key`` has no match in ``dim``: the quarantine
    output of ``on_missing='drop'``."""
    return samples.join(dim.select(key), key, "left_anti")


def write_copartitioned(df: DataFrame, table: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """Store a table bucketed and sorted by ``key`` under ``path`` and return
    it.  Tables with the same number of buckets join on ``key`` without a
    shuffle, however often.  One file per bucket: the rows are dealt out by
    the hash that buckets use.  Take buckets so that one holds about 200 MB."""
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def zip_outputs(ids: DataFrame, *outputs: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Outputs of separate runs beside their ids, by position: one row per
    ``ord`` of ``ids``.  A position that an output lacks has NULLs there; one
    that ``ids`` lacks is an error, as is a position that occurs twice."""
    zipped = ids
    for other in outputs:
        repeated = other.groupBy(ord_col).count().where("count > 1").limit(1).collect()
        stray = other.select(ord_col).join(ids, ord_col, "left_anti").limit(1).collect()
        if repeated or stray:
            raise KeyError(f"position {(repeated or stray)[0][ord_col]} {'occurs twice' if repeated else 'has no id'}")
        zipped = zipped.join(other, ord_col, "left")
    return zipped
