"""Array expressions: padding, entropy, EOS truncation."""

from pyspark.sql import Column, functions as F

from ._col import as_col


def pad_ids(ids, length, pad_id: int, side: str = "right") -> Column:
    ids = as_col(ids)
    fill = F.array_repeat(F.lit(pad_id), as_col(length) - F.size(ids))
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def pad_mask(ids, length, side: str = "right") -> Column:
    ids = as_col(ids)
    ones = F.array_repeat(F.lit(1), F.size(ids))
    zeros = F.array_repeat(F.lit(0), as_col(length) - F.size(ids))
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)


def entropy(logits) -> Column:
    """Shannon entropy (nats) of softmax(logits), one pass, stable.

    The accumulator keeps the running max ``m``, ``z = sum e^(x-m)`` and
    ``s = sum (x-m) e^(x-m)``; the result is ``ln z - s / z``.  A ``-inf``
    logit adds nothing (0 * ln 0 = 0), which fixes the NaN of the plain
    ``probs * log_probs`` product.
    """
    init = F.struct(
        F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("z"), F.lit(0.0).alias("s")
    )

    def merge(acc, x):
        x = x.cast("double")
        m, z, s = acc["m"], acc["z"], acc["s"]
        r = F.exp(m - x)
        grow = F.struct(
            x.alias("m"),
            (z * r + F.lit(1.0)).alias("z"),
            F.when(z == 0, F.lit(0.0)).otherwise((s + (m - x) * z) * r).alias("s"),
        )
        e = F.exp(x - m)
        add = F.struct(m.alias("m"), (z + e).alias("z"), (s + (x - m) * e).alias("s"))
        return (
            F.when(x == float("-inf"), acc)
            .when(x > m, grow)
            .otherwise(add)
        )

    return F.aggregate(
        as_col(logits), init, merge, lambda acc: F.log(acc["z"]) - acc["s"] / acc["z"]
    )


def truncate_at_eos(seq, scores, eos_id: int, start) -> Column:
    """Keep ``scores`` up to and including the first ``eos_id`` found in
    ``seq`` from 1-based position ``start`` on; no EOS keeps everything."""
    seq = as_col(seq)
    start = as_col(start) if not isinstance(start, int) else F.lit(start)
    tail = F.slice(seq, start, F.greatest(F.size(seq) - start + 1, F.lit(0)))
    p = F.array_position(tail, F.lit(eos_id))
    scores = as_col(scores)
    return F.when(p == 0, scores).otherwise(F.slice(scores, F.lit(1), p.cast("int")))
