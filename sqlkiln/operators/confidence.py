"""Confidence scoring: per-step entropy, EOS truncation, max-entropy score
and last-wins result assembly.

Array form: one row per generated sequence with its per-step scores.  Long
form: one row per (sequence, step) or (sequence, step, vocab entry); every
long-form operator uses partially aggregated ``groupBy`` (no window over a
sequence), so a hot sequence never lands whole in one task before the
map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.arrays import entropy, truncate_at_eos
from ..session import DEFAULT_BROADCAST_BYTES, broadcast_if_small

MODES = ("aligned", "compat")


def step_entropy(df: DataFrame, logits_col: str = "logits", out: str = "entropy") -> DataFrame:
    """Entropy (nats) of softmax over one step's logits (``ARRAY<num>``)."""
    return df.withColumn(out, entropy(F.col(logits_col)))


def step_entropies(df: DataFrame, steps_col: str = "step_logits", out: str = "entropies") -> DataFrame:
    """``ARRAY<ARRAY<num>>`` (steps x vocab) -> ``ARRAY<DOUBLE>``."""
    return df.withColumn(out, F.transform(F.col(steps_col), lambda v: entropy(v)))


def softmax_states(keys: pd.DataFrame, logits: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """One accumulator ``(m, z, s)`` per key of a chunk of logits: the largest
    logit, ``z = sum e^(x-m)`` and ``s = sum (x-m) e^(x-m)``.  A ``-inf`` logit
    adds nothing; a missing one is left out."""
    codes = keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    order = order[~np.isnan(logits[order])]
    x, codes = logits[order], codes[order]
    if not len(x):
        return keys.iloc[:0], x, x, x
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    m = np.maximum.reduceat(x, starts)
    live = ~np.isneginf(x)
    d = np.where(live, x - np.where(np.isneginf(m), 0.0, m)[np.cumsum(np.isin(np.arange(len(x)), starts)) - 1], 0.0)
    e = np.where(live, np.exp(d), 0.0)
    return keys.iloc[order[starts]], m, np.add.reduceat(e, starts), np.add.reduceat(d * e, starts)


def merged_entropy(states: Column) -> Column:
    """Entropy from accumulators of parts of one distribution: each is scaled
    from its own largest logit to the largest of all."""
    top = F.array_max(F.transform(states, lambda a: a["m"]))

    def scale(a: Column) -> Column:
        return F.when(a["m"] == float("-inf"), F.lit(0.0)).otherwise(F.exp(a["m"] - top))

    def shift(a: Column) -> Column:
        return F.when(a["m"] == float("-inf"), F.lit(0.0)).otherwise(a["m"] - top)

    z = F.aggregate(states, F.lit(0.0), lambda t, a: t + scale(a) * a["z"])
    s = F.aggregate(states, F.lit(0.0), lambda t, a: t + scale(a) * (a["s"] + shift(a) * a["z"]))
    return F.when(z > 0, F.log(z) - s / z).otherwise(F.lit(float("nan")))


def step_entropy_long(df: DataFrame, keys: list[str], logit_col: str = "logit", out: str = "entropy") -> DataFrame:
    """Long form (keys..., logit): one scan and one shuffle.  Every Arrow
    batch is reduced where it lies to one accumulator per key (so a hot key
    shuffles one row per batch that holds it, not its logits), and the
    accumulators of a key are merged.  ``-inf`` logits add nothing, a NULL or
    NaN logit is left out, and a key with no finite logit has entropy NaN; a
    key with missing logits only has no row."""
    held = df.select(*keys, F.col(logit_col).cast("double").alias("__x"))
    state = T.StructType([*held.select(*keys).schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("__m", "__z", "__s"))])
    arrow = to_arrow_schema(state)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pd.DataFrame({k: batch.column(i).to_pandas() for i, k in enumerate(keys)})
            x = batch.column(len(keys)).to_numpy(zero_copy_only=False).astype(np.float64)
            found, *parts = softmax_states(names, x)
            rows = batch.select(keys).take(pa.array(found.index.to_numpy()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, parts)], schema=arrow)

    parts = held.mapInArrow(reduce, state)
    merged = parts.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("__m").alias("m"), F.col("__z").alias("z"), F.col("__s").alias("s"))).alias("__a"))
    return merged.select(*keys, merged_entropy(F.col("__a")).alias(out))


def truncate_scores(df: DataFrame, seq_col: str = "seq", scores_col: str = "scores", eos_id: int = 0,
                    mode: str = "aligned", input_len_col: str = "input_len", out: str | None = None) -> DataFrame:
    """Cut the scores after the first EOS (inclusive).

    ``aligned`` (default) looks for EOS among the generated ids only
    (``seq[input_len:]``).  ``compat`` reproduces the original, which searches
    ``seq[1:]`` of prompt + output, so left padding by EOS cuts early."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    start = F.col(input_len_col) + 1 if mode == "aligned" else 2
    return df.withColumn(out or scores_col, truncate_at_eos(F.col(seq_col), F.col(scores_col), eos_id, start))


def confidence(df: DataFrame, scores_col: str = "scores", out: str = "score") -> DataFrame:
    """Max entropy over the kept steps (higher = less sure)."""
    return df.withColumn(out, F.array_max(F.col(scores_col)))


def first_eos_long(df: DataFrame, keys: list[str], order_col: str, eos_col: str) -> DataFrame:
    """(keys..., first_eos): the order value of the first EOS step per
    sequence; sequences without EOS are absent."""
    return df.filter(F.col(eos_col)).groupBy(*keys).agg(F.min(order_col).alias("first_eos"))


def truncate_scores_long(df: DataFrame, keys: list[str], order_col: str, eos_col: str,
                         max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Long form of the EOS cut: keep steps up to and including the first
    EOS of their sequence; all steps when there is none.  The per-sequence
    cut-off table is broadcast when measured small, else shuffle-joined (AQE
    splits hot keys)."""
    cut = broadcast_if_small(first_eos_long(df, keys, order_col, eos_col), max_broadcast_bytes)
    j = df.join(cut, keys, "left")
    return j.filter(F.col("first_eos").isNull() | (F.col(order_col) <= F.col("first_eos"))).drop("first_eos")


def confidence_long(df: DataFrame, keys: list[str], score_col: str, out: str = "score") -> DataFrame:
    """(keys..., n_steps, score): steps kept and their max score."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_steps"), F.max(score_col).alias(out))


def last_by_id(df: DataFrame, id_col: str = "id", ord_col: str = "ord", value_cols: list[str] | None = None) -> DataFrame:
    """One row per id: the values of its latest occurrence by ``ord`` (the
    result dictionary keeps the last write).  ``max_by`` aggregates partially
    before the shuffle on ``id``."""
    value_cols = value_cols or [c for c in df.columns if c not in (id_col,)]
    packed = F.max_by(F.struct(*[F.col(c) for c in value_cols]), F.col(ord_col)).alias("__v")
    return df.groupBy(id_col).agg(packed).select(id_col, *[F.col(f"__v.{c}").alias(c) for c in value_cols])


def results(df: DataFrame, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """(id, sql, score) with the last occurrence of each id."""
    return last_by_id(df.select(id_col, ord_col, "sql", "score"), id_col, ord_col, [ord_col, "sql", "score"])
