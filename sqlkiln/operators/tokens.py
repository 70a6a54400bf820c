"""Tokenised-dataset operators: tokenise, truncate, pad, length profile,
training-step budget, round-trip check and the completion-only loss mask.

Tokenizers run on Arrow batches in the workers: the built-in one (one id per
code point) as one zero-copy buffer per batch, any other as a
``TokenizerSpec`` loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .. import fixed
from ..batches import in_pieces, piece_bounds, sizes
from ..functions.arrays import pad_ids, pad_mask


# --- pluggable tokenizers ----------------------------------------------------

class CodepointTokenizer:
    """One id per Unicode code point; id 0 doubles as end-of-sequence/pad."""

    eos_id = 0

    def token_id(self, token: str) -> int | None:
        return ord(token) if len(token) == 1 else None

    def encode_batch(self, texts: list[str]):
        return [None if t is None else np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
                for t in texts]

    def decode_batch(self, ids: list[list[int]], skip_special_tokens: bool = False) -> list[str]:
        out = []
        for row in ids:
            if row is None:
                out.append(None)
                continue
            row = [int(i) for i in row if not (skip_special_tokens and int(i) == self.eos_id)]
            out.append("".join(chr(i) for i in row))
        return out


class _FileTokenizer:
    """A ``tokenizer.json`` read with the ``tokenizers`` library."""

    def __init__(self, path: str, eos_token: str | None):
        from tokenizers import Tokenizer  # gated: only needed for this kind

        self._tok = Tokenizer.from_file(path)
        self.eos_id = self._tok.token_to_id(eos_token) if eos_token else None
        if eos_token and self.eos_id is None:
            raise ValueError(f"end-of-sequence token {eos_token!r} is not in the vocabulary")

    def token_id(self, token: str) -> int | None:
        """Id of a token of the vocabulary (special tokens included)."""
        return self._tok.token_to_id(token)

    def encode_batch(self, texts):
        idx = [i for i, t in enumerate(texts) if t is not None]
        enc = self._tok.encode_batch([texts[i] for i in idx], add_special_tokens=False)
        out = [None] * len(texts)
        for i, e in zip(idx, enc):
            out[i] = e.ids
        return out

    def decode_batch(self, ids, skip_special_tokens: bool = False):
        return [None if r is None else self._tok.decode([int(i) for i in r], skip_special_tokens=skip_special_tokens)
                for r in ids]


@dataclass(frozen=True)
class TokenizerSpec:
    """Hashable description of a tokenizer, shipped to workers and loaded
    once per worker process."""

    kind: str = "codepoint"
    path: str | None = None
    eos_token: str | None = None

    def load(self):
        if self.kind in ("codepoint", "codepoint_arrow"):
            # "codepoint_arrow" runs the same tokenizer on the Arrow path.
            return CodepointTokenizer()
        if self.kind == "file":
            return _FileTokenizer(self.path, self.eos_token)
        raise ValueError(f"unknown tokenizer kind {self.kind!r}")


CODEPOINT = TokenizerSpec()
_LOADED: dict = {}
# A worker makes about so many ids at a time: an Arrow batch holds up to 10,000
# texts, whose ids, labels and masks take 30 times its bytes at once.
PIECE_IDS = 1 << 18


def load_once(spec):
    """Per-process cache: a worker loads each tokenizer/model once."""
    obj = _LOADED.get(spec)
    if obj is None:
        obj = _LOADED[spec] = spec.load()
    return obj


# --- operators ---------------------------------------------------------------

def _series_pieces(texts: pd.Series) -> Iterator[pd.Series]:
    if texts.empty:
        yield texts
    for a, b in piece_bounds(np.array([0 if t is None else len(t) for t in texts], np.int64), PIECE_IDS):
        yield texts.iloc[a:b]


def codepoint_lists(texts: pa.Array, max_len: int | None = None) -> pa.Array:
    """Code points of a string column as an Arrow list column: one buffer of
    32-bit units is the values, the text lengths are the offsets."""
    found = texts.to_pylist()
    cut = ["" if t is None else t[:max_len] for t in found]
    values = np.frombuffer("".join(cut).encode("utf-32-le"), np.int32)
    offsets = np.zeros(len(cut) + 1, np.int32)
    np.cumsum([len(t) for t in cut], out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pc.if_else(pa.array([t is not None for t in found]), lists, pa.scalar(None, lists.type)) if None in found else lists


def tokenize(df: DataFrame, text_col: str = "text", out: str = "input_ids", spec: TokenizerSpec | None = None,
             max_len: int | None = None) -> DataFrame:
    """Tokenise texts, no special tokens added, cut to the first ``max_len``
    ids if given.  Code points need no more than the first ``max_len``
    characters, so a long text is cut before it leaves the JVM; their ids are
    one zero-copy buffer per Arrow batch."""
    spec = spec or CODEPOINT
    if spec.kind.startswith("codepoint"):
        text = F.col(text_col) if max_len is None else F.substring(F.col(text_col), 1, max_len)

        @F.arrow_udf("array<int>")
        def points(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for texts, _ in batches:
                yield from in_pieces(lambda t: codepoint_lists(t, max_len), texts, PIECE_IDS)

        # Two arguments, see ``tokenize_with_labels``.
        x = df.withColumn("__text", text)
        return x.withColumn(out, points(F.col("__text"), F.length("__text"))).drop("__text")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load_once(spec)
        for s in batches:
            for part in _series_pieces(s):
                yield pd.Series([None if e is None else e[:max_len] for e in tok.encode_batch(part.tolist())])

    return df.withColumn(out, encode(F.col(text_col)))


def count_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", spec: TokenizerSpec | None = None) -> DataFrame:
    """Token count of whole texts without keeping the ids: for code points
    the native character count, otherwise the tokenizer on Arrow batches."""
    spec = spec or CODEPOINT
    if spec.kind == "codepoint":
        return df.withColumn(out, F.length(F.col(text_col)).cast("int"))

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load_once(spec)
        for s in batches:
            for part in _series_pieces(s):
                yield pd.Series([None if e is None else len(e) for e in tok.encode_batch(part.tolist())], dtype="Int32")

    return df.withColumn(out, count(F.col(text_col)))


def decode(df: DataFrame, ids_col: str, out: str, spec: TokenizerSpec | None = None,
           skip_special_tokens: bool = False) -> DataFrame:
    spec = spec or CODEPOINT

    @F.pandas_udf(T.StringType())
    def dec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load_once(spec)
        for s in batches:
            yield pd.Series(tok.decode_batch(s.tolist(), skip_special_tokens=skip_special_tokens))

    return df.withColumn(out, dec(F.col(ids_col)))


def truncate(df: DataFrame, ids_col: str, max_len: int, out: str | None = None) -> DataFrame:
    """Keep the first ``max_len`` ids (right-side truncation)."""
    return df.withColumn(out or ids_col, F.slice(F.col(ids_col), 1, max_len))


def max_length(df: DataFrame, col: str, max_len: int | None = None) -> DataFrame:
    """One row: the longest sequence, at most ``max_len`` (the padding
    target).  ``col`` is an id array, or a token count (``count_tokens``),
    which needs no ids at all."""
    size = _count(df, col)
    return df.agg(F.max(size if max_len is None else F.least(size, F.lit(max_len))).cast("int").alias("max_len"))


def pad(df: DataFrame, ids_col: str = "input_ids", pad_id: int = 0, side: str = "right", length: int | None = None,
        mask_col: str = "attention_mask") -> DataFrame:
    """Pad every sequence to the longest in the whole dataset (or to
    ``length``) and add the attention mask.  Right for training, left for
    generation.  Give ``length`` from ``max_length`` over token counts to
    save tokenising twice: without it the ids are built once to be measured
    and once to be padded."""
    if side not in ("right", "left"):
        raise ValueError("side must be 'right' or 'left'")
    if length is None:
        length = max_length(df, ids_col).first()["max_len"] or 0
    df = df.withColumn("__L", F.lit(int(length)))
    return (
        df.withColumn(mask_col, pad_mask(ids_col, "__L", side))
        .withColumn(ids_col, pad_ids(ids_col, "__L", pad_id, side))
        .drop("__L")
    )


def _count(df: DataFrame, col: str):
    """Length of an id array, or the value of a precomputed count column."""
    t = df.schema[col].dataType
    return F.size(F.col(col)) if isinstance(t, T.ArrayType) else F.col(col)


def length_profile(df: DataFrame, ids_col: str, max_len: int, by: list[str] | None = None) -> DataFrame:
    """Prompt length profile after truncation at ``max_len``; ``ids_col`` is
    an id array or a token count (``count_tokens``).

    ``mean_len_compat`` leaves rows at the limit out of the sum but keeps them
    in the divisor (the original's number); ``mean_len`` is the plain mean."""
    x = df.select(*(by or []), F.least(_count(df, ids_col), F.lit(max_len)).alias("__n"))
    agg = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("__n") == max_len).alias("n_at_limit"),
        (F.coalesce(F.sum(F.when(F.col("__n") != max_len, F.col("__n"))), F.lit(0)) / F.count(F.lit(1))).alias(
            "mean_len_compat"),
        F.avg("__n").alias("mean_len"),
    ]
    return x.groupBy(*(by or [])).agg(*agg)


def step_budget(df: DataFrame, batch_size: int, grad_accum: int, epochs: float, by: list[str] | None = None) -> DataFrame:
    """Optimizer steps per epoch ``max(n // (bs*gas), 1)``, total
    ``ceil(epochs * per_epoch)``, warm-up ``int(0.03 * total)``; a checkpoint
    is saved every epoch."""
    per_epoch = F.greatest(F.floor(F.col("n_rows") / F.lit(batch_size * grad_accum)), F.lit(1)).cast("long")
    counted = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.ceil(F.lit(float(epochs)) * F.col("steps_per_epoch")).cast("long")
    return (
        counted.withColumn("steps_per_epoch", per_epoch)
        .withColumn("total_steps", total)
        .withColumn("warmup_steps", F.floor(F.lit(fixed.WARMUP_FRACTION) * F.col("total_steps")).cast("long"))
        .withColumn("save_steps", F.col("steps_per_epoch"))
    )


def roundtrip_failures(df: DataFrame, text_col: str, max_len: int, spec: TokenizerSpec | None = None,
                       by: list[str] | None = None) -> DataFrame:
    """Rows below the length limit whose ``decode(encode(text))`` differs
    from the text; per group: rows checked and failures (zero expected)."""
    spec = spec or CODEPOINT
    toks = tokenize(df.select(*(by or []), text_col), text_col, "__ids", spec)
    under = toks.filter(F.size("__ids") < max_len)
    back = decode(under, "__ids", "__back", spec)
    return back.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(F.col("__back") != F.col(text_col)).alias("n_failures"),
    )


def completion_labels(df: DataFrame, ids_col: str, header_ids: list[int], out: str = "labels",
                      pad_id: int | None = None) -> DataFrame:
    """Loss labels for completion-only training: every position up to the
    end of the last occurrence of the response header is ``-100``; no header
    means all ``-100``; pad ids are ``-100`` as well."""
    if not header_ids:
        raise ValueError("header_ids must not be empty")
    hdr = np.asarray(header_ids, dtype=np.int64)

    @F.arrow_udf("array<int>")
    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield from in_pieces(lambda i: _label_lists(i, hdr, pad_id), ids, PIECE_IDS)

    return df.withColumn(out, labels(F.col(ids_col)))


def _label_lists(ids: pa.Array, hdr: np.ndarray, pad_id: int | None) -> pa.Array:
    """Labels of a list column, written over one copy of its values.  Only
    places where the header's first id stands are compared with it."""
    values = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    lengths = sizes(ids)
    ends = np.cumsum(lengths)
    k, hit = hdr.size, np.flatnonzero(values[: max(0, values.size - hdr.size + 1)] == hdr[0])
    for j in range(1, k):
        hit = hit[values[hit + j] == hdr[j]]
    row = np.searchsorted(ends, hit, side="right")
    inside = hit + k <= ends[row] if len(hit) else np.zeros(0, bool)
    cut = ends.copy()
    cut[row[inside]] = hit[inside] + k  # hits are in order: the last of a row stays
    masked = np.arange(values.size) < np.repeat(cut, lengths)
    if pad_id is not None:
        masked |= values == pad_id
    out = np.where(masked, np.int32(fixed.IGNORE_INDEX), values)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()))
    return pc.if_else(ids.is_valid(), lists, pa.scalar(None, lists.type)) if ids.null_count else lists


def _padded(ids: pa.Array, length: int, pad_id: int) -> pa.Array:
    """A list column filled up on the right to ``length``; nulls stay null."""
    lengths = sizes(ids)
    if len(lengths) and lengths.max() > length:
        raise ValueError(f"a text of {lengths.max()} tokens does not fit {length}; give max_len")
    out = np.full((len(lengths), length), pad_id, np.int32)
    out[np.arange(length) < lengths[:, None]] = ids.flatten().to_numpy(zero_copy_only=False)
    offsets = pa.array(np.arange(len(lengths) + 1, dtype=np.int32) * length)
    lists = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
    return pc.if_else(ids.is_valid(), lists, pa.scalar(None, lists.type)) if ids.null_count else lists


def _ids_and_labels(batches: Iterator[pa.Array], header_text: str, spec: TokenizerSpec, pad_id: int | None,
                    max_len: int | None, pad_to: int | None) -> Iterator[pa.Array]:
    """(ids, labels) of text columns, in pieces of ``PIECE_IDS``; a padded
    row counts as long as it gets."""
    tok = load_once(spec)
    hdr = np.asarray(tok.encode_batch([header_text])[0], dtype=np.int64)

    def both(texts: pa.Array) -> pa.Array:
        if spec.kind.startswith("codepoint"):
            ids = codepoint_lists(texts, max_len)
        else:
            ids = pa.array([None if e is None else list(e[:max_len]) for e in tok.encode_batch(texts.to_pylist())],
                           pa.list_(pa.int32()))
        if pad_to is not None:
            ids = _padded(ids, pad_to, pad_id)
        return pa.StructArray.from_arrays([ids, _label_lists(ids, hdr, pad_id)], names=["ids", "labels"])

    for texts in batches:
        yield from in_pieces(both, texts, PIECE_IDS, pad_to or 0)


def tokenize_with_labels(df: DataFrame, text_col: str, header_text: str, spec: TokenizerSpec | None = None,
                         ids_out: str = "input_ids", labels_out: str = "labels", pad_id: int | None = None,
                         max_len: int | None = None, pad_to: int | None = None) -> DataFrame:
    """The training token set as one job: tokenise, cut to ``max_len``, pad on
    the right to ``pad_to`` with ``pad_id``, and mask.  The header is searched
    in what is left after the cut, so a text whose last header lies beyond it
    is masked up to an earlier one, or wholly.  The ids enter Python once."""
    spec = spec or CODEPOINT
    if not header_text:
        raise ValueError("header_text must not be empty")
    if pad_to is not None and pad_id is None:
        raise ValueError("pad_to needs a pad_id")
    text = F.col(text_col)
    if spec.kind.startswith("codepoint") and max_len is not None:
        text = F.substring(text, 1, max_len)

    # The text is named in two arguments, so the optimizer keeps it as a column
    # of its own below the UDF: a UDF over an expression with lambdas (SQL
    # normalisation has some) cannot be planned.
    @F.arrow_udf("ids array<int>, labels array<int>")
    def made(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return _ids_and_labels((texts for texts, _ in batches), header_text, spec, pad_id, max_len, pad_to)

    x = df.withColumn("__text", text)
    x = x.withColumn("__tl", made(F.col("__text"), F.length("__text"))).drop("__text")
    return x.withColumn(ids_out, F.col("__tl.ids")).withColumn(labels_out, F.col("__tl.labels")).drop("__tl")
