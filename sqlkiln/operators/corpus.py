"""Corpus text jobs: question cleaning, generated-SQL post-processing and
gold-SQL normalisation, as projections over whole columns (no Python but in
the token mode of the alias stage)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import sqlnorm, sqlscope
from ..functions.text import clean_question, postprocess_generated_sql


def clean_questions(df: DataFrame, col: str = "question", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, clean_question(col))


def postprocess_sql(df: DataFrame, col: str = "sql", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, postprocess_generated_sql(col))


ALIAS_MODES = ("compat", "token")


def resolve_aliases(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Aliases resolved by query block, token by token (see
    ``functions.sqlscope``), on Arrow batches; null stays null."""
    def resolve(sql: pa.Array) -> pa.Array:
        return pa.array([sqlscope.resolve_aliases(s) for s in sql.to_pylist()], pa.string())

    # Two arguments keep the text a column of its own below the UDF: one over
    # an expression with lambdas cannot be planned.
    made = F.arrow_udf(lambda sql, _: resolve(sql), "string")
    return df.withColumn(out or col, made(F.col(col), F.length(F.col(col))))


def normalize_sql(df: DataFrame, col: str = "query", out: str | None = None, upto: str | None = None,
                  alias_mode: str = "compat") -> DataFrame:
    """Run the normalisation stages in order, each as its own projection.

    ``alias_mode='compat'`` (default) replaces aliases as substrings of the
    whole text, as the original does; ``'token'`` resolves them by query block
    and never changes a literal or a longer word.

    The alias stage needs its bindings computed once per row, so they are a
    separate column; Spark keeps such a column in its own projection because
    it is referenced more than once.  ``upto`` stops after the named stage.
    """
    if alias_mode not in ALIAS_MODES:
        raise ValueError(f"alias_mode must be one of {ALIAS_MODES}")
    out = out or col
    tmp = "__nrm"
    cur = df.withColumn(tmp, F.col(col))
    for name, stage in sqlnorm.NORMALIZE_STAGES:
        if name == "alias" and alias_mode == "token":
            cur = resolve_aliases(cur, tmp)
        elif name == "alias":
            cur = cur.withColumn("__bind", sqlnorm.alias_bindings(sqlnorm.alias_region(tmp)))
            cur = cur.withColumn(tmp, sqlnorm.apply_aliases(tmp, "__bind")).drop("__bind")
        else:
            cur = cur.withColumn(tmp, stage(tmp))
        if name == upto:
            break
    return cur.withColumn(out, F.col(tmp)).drop(tmp) if out != tmp else cur
