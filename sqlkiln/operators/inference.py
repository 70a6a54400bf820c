"""Batch generation over a prompt table, with confidence scoring done inside
the worker so raw logits (steps x vocab per sample) never leave it.

The ``ord`` values alone are numbered densely and cut into sequential
batches; the prompts join their batch number and are dealt out by it, so a
batch never straddles two tasks.  Each worker process loads the model once.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.text import postprocess_generated_sql
from .ordering import with_batch_id
from .tokens import CODEPOINT, TokenizerSpec, count_tokens, load_once, max_length

OUTPUT_SCHEMA = "ord long, id string, batch_id long, raw_sql string, entropies array<double>, score double"


# --- numpy side of the scoring (inside the worker) ---------------------------

def entropy_rows(logits: np.ndarray) -> np.ndarray:
    """Entropy (nats) of softmax over the last axis; a ``-inf`` logit adds 0."""
    x = logits.astype(np.float64)
    m = np.max(x, axis=-1, keepdims=True)
    d = x - m
    e = np.exp(d)
    z = e.sum(axis=-1)
    s = np.where(np.isneginf(x), 0.0, d * e).sum(axis=-1)
    return np.log(z) - s / z


def cut_at_eos(seq: np.ndarray, scores: np.ndarray, eos_ids: set[int], start: int) -> np.ndarray:
    """Scores up to and including the first EOS in ``seq[start:]``."""
    tail = seq[start:]
    hits = np.nonzero(np.isin(tail, list(eos_ids)))[0]
    return scores[: hits[0] + 1] if hits.size else scores


def stop_ends(values: np.ndarray, offsets: np.ndarray, stops: list[list[int]]) -> np.ndarray:
    """For each list ``values[offsets[i]:offsets[i + 1]]``, how many of its
    ids are kept when it ends with the first stop sequence it completes (all,
    when it has none).  All lists are searched at once: places where a stop's
    first id stands are narrowed down id by id."""
    begins, ends = offsets[:-1], offsets[1:]
    first = ends.copy()
    for stop in stops:
        hit = np.flatnonzero(values[: max(0, len(values) - len(stop) + 1)] == stop[0])
        for j in range(1, len(stop)):
            hit = hit[values[hit + j] == stop[j]]
        row = np.searchsorted(ends, hit, side="right")
        done = hit + len(stop)
        inside = np.flatnonzero((row < len(ends)) & (done <= ends[np.minimum(row, len(ends) - 1)])) if len(hit) else hit
        np.minimum.at(first, row[inside], done[inside])
    return first - begins


def end_at_stops(seqs: np.ndarray, start: int, stops: list[list[int]], eos: int) -> np.ndarray:
    """Generated ids (from ``start``) with everything after the first stop
    sequence replaced by ``eos``, as a model pads what it no longer writes."""
    made = np.ascontiguousarray(seqs[:, start:])
    n, width = made.shape
    kept = stop_ends(made.ravel(), np.arange(n + 1) * width, stops) if n and width else np.zeros(n, int)
    tail = np.where(np.arange(width) < kept[:, None], made, eos)
    return np.concatenate([seqs[:, :start], tail], axis=1)


def cut_at_stops(df: DataFrame, ids_col: str, stops: list[list[int]], out: str = "kept") -> DataFrame:
    """Add how many ids of each row's list stay when it ends with the first
    of the ``stops`` (id sequences) it completes, that one included; a null
    list stays null."""
    if not stops or not all(stops):
        raise ValueError("stops must be non-empty id sequences")

    def cut(ids: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        kept = stop_ends(ids.flatten().to_numpy(zero_copy_only=False), offsets, stops)
        return pa.array(kept, pa.int64(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return df.withColumn(out, F.arrow_udf(cut, "long")(F.col(ids_col)))


# --- models ------------------------------------------------------------------

class LookupModel:
    """Deterministic stand-in generator (for tests and benches).

    Answers ``SELECT count(*) FROM <name>;`` where the name is the first
    ``Table <name>,`` of the (truncated) prompt, else the first word after
    ``QUESTION: ``; with neither, ``SELECT 1;``.  One code point per step;
    the logits of a step over a 32-entry vocabulary are
    ``-|k - tok % 32| * (0.5 + (tok % 7) / 4)``, so entropies vary by token."""

    vocab = 32

    def __init__(self, log_dir: str | None = None):
        if log_dir:
            import os
            import uuid

            with open(os.path.join(log_dir, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w"):
                pass

    def _answer(self, prompt: str) -> str:
        at = prompt.find("Table ")
        if at >= 0:
            end = prompt.find(",", at)
            if end > at:
                return f"SELECT count(*) FROM {prompt[at + 6:end]};"
        q = prompt.find("QUESTION: ")
        if q >= 0:
            rest = prompt[q + 10:]
            n = 0
            while n < len(rest) and rest[n].isalpha():
                n += 1
            if n:
                return f"SELECT count(*) FROM {rest[:n]};"
        return "SELECT 1;"

    def generate(self, input_ids: np.ndarray, attention_mask: np.ndarray, max_new_tokens: int, eos_ids: list[int],
                 pad_id: int, decode) -> tuple[np.ndarray, list[np.ndarray]]:
        b = input_ids.shape[0]
        prompts = decode([row[mask.astype(bool)].tolist() for row, mask in zip(input_ids, attention_mask)])
        outs = []
        for p in prompts:
            ids = [ord(c) for c in self._answer(p)][:max_new_tokens]
            stop = next((i for i, t in enumerate(ids) if t in eos_ids), None)
            outs.append(ids if stop is None else ids[: stop + 1])
        steps = max((len(o) for o in outs), default=0)
        gen = np.full((b, steps), pad_id, dtype=np.int64)
        logits = []
        for j in range(steps):
            step = np.zeros((b, self.vocab))
            for i, o in enumerate(outs):
                tok = o[j] if j < len(o) else pad_id
                if j < len(o):
                    gen[i, j] = tok
                peak = tok % self.vocab
                step[i] = -np.abs(np.arange(self.vocab) - peak) * (0.5 + (tok % 7) / 4.0)
            logits.append(step)
        return np.concatenate([input_ids.astype(np.int64), gen], axis=1), logits


@dataclass(frozen=True)
class ModelSpec:
    """Hashable model description; loaded once per worker process.  ``kind``
    is ``lookup`` or the import path ``module:function`` of a factory that
    takes ``name`` and returns an object with ``generate``."""

    kind: str = "lookup"
    name: str | None = None
    log_dir: str | None = None

    def load(self):
        if self.kind == "lookup":
            return LookupModel(self.log_dir)
        module, _, factory = self.kind.partition(":")
        if not factory:
            raise ValueError(f"unknown model kind {self.kind!r}")
        return getattr(importlib.import_module(module), factory)(self.name)


# --- the distributed job -------------------------------------------------------

def terminators(tok, eos_id: int) -> list[list[int]]:
    """Id sequences that end a generation: end of sequence, end of turn and
    the statement ends.  What the vocabulary has as one token is one id, any
    other is spelled with the tokenizer."""
    found = [[eos_id]]
    for text in (fixed.END_OF_TURN, *fixed.TERMINATOR_TOKENS):
        token = tok.token_id(text)
        ids = [int(token)] if token is not None else [int(i) for i in tok.encode_batch([text])[0]]
        if ids and ids not in found:
            found.append(ids)
    return found


def eos_of(tok) -> int:
    if getattr(tok, "eos_id", None) is None:
        raise ValueError("the tokenizer has no end-of-sequence id; name its token in TokenizerSpec(eos_token=...)")
    return int(tok.eos_id)


def generate(df: DataFrame, model: ModelSpec, tokenizer: TokenizerSpec = CODEPOINT, *, batch_size: int = 12,
             max_seq_length: int = 256, max_new_tokens: int = 256, num_beams: int = 1, mode: str = "aligned",
             text_col: str = "text", num_partitions: int | None = None) -> DataFrame:
    """(ord, id, text) -> (ord, id, batch_id, sql, entropies, score).

    Prompts are truncated to ``max_seq_length`` tokens and left-padded with
    the EOS id, to the longest prompt of their batch, or of the whole dataset
    in ``compat`` mode.  ``mode='aligned'`` searches EOS among generated ids;
    ``'compat'`` searches ``seq[1:]`` of prompt + output as the original does.
    ``ord`` must be unique."""
    if num_beams != 1:
        raise ValueError("confidence scoring needs num_beams == 1 (rows would be batch x beams)")
    if mode not in ("aligned", "compat"):
        raise ValueError("mode must be 'aligned' or 'compat'")
    # Only (ord, id) is numbered and checkpointed; the texts join it once, by
    # batch, so a batch never straddles two tasks and a prompt moves once.
    numbered = with_batch_id(df.select("ord"), batch_size, num_partitions=num_partitions)
    texts = df.select("ord", "id", text_col).join(numbered, "ord")
    batched = texts.repartition("batch_id").sortWithinPartitions("batch_id", "ord")
    # The original pads to the longest prompt of the whole dataset; that only
    # shows in ``compat``, which looks for the end in the padding too.
    whole = None
    if mode == "compat":
        whole = max_length(count_tokens(df, text_col, "__n", tokenizer), "__n", max_seq_length).first()["max_len"] or 0

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load_once(tokenizer)
        lm = load_once(model)
        eos = eos_of(tok)
        stops = terminators(tok, eos)
        single = [s[0] for s in stops if len(s) == 1]  # these the model itself can stop at
        pending = []

        def score_batch(rows: pd.DataFrame) -> pd.DataFrame:
            enc = [ids[:max_seq_length] for ids in tok.encode_batch(rows[text_col].tolist())]
            width = max((len(e) for e in enc), default=0) if whole is None else whole
            ids = np.full((len(enc), width), eos, dtype=np.int64)
            mask = np.zeros((len(enc), width), dtype=np.int64)
            for i, e in enumerate(enc):
                if len(e):
                    ids[i, width - len(e):] = e
                    mask[i, width - len(e):] = 1
            seqs, logits = lm.generate(ids, mask, max_new_tokens, single, eos, tok.decode_batch)
            seqs = end_at_stops(seqs, width, stops, eos)
            steps = len(logits)
            ent = np.stack([entropy_rows(s) for s in logits], axis=1) if steps else np.zeros((len(enc), 0))
            start = width if mode == "aligned" else 1
            kept = [cut_at_eos(seqs[i], ent[i], {eos}, start) for i in range(len(enc))]
            texts = tok.decode_batch([seqs[i, width:].tolist() for i in range(len(enc))], skip_special_tokens=True)
            return pd.DataFrame({
                "ord": rows["ord"].to_numpy(), "id": rows["id"].to_numpy(), "batch_id": rows["batch_id"].to_numpy(),
                "raw_sql": texts, "entropies": [k.tolist() for k in kept],
                "score": [float(k.max()) if k.size else float("nan") for k in kept],
            })

        current = None
        for pdf in it:
            for bid, grp in pdf.groupby("batch_id", sort=False):
                if current is not None and bid != current:
                    yield score_batch(pd.concat(pending, ignore_index=True))
                    pending = []
                current = bid
                pending.append(grp)
        if pending:
            yield score_batch(pd.concat(pending, ignore_index=True))

    out = batched.mapInPandas(run, OUTPUT_SCHEMA)
    return out.select("ord", "id", "batch_id", postprocess_generated_sql("raw_sql").alias("sql"), "entropies",
                      "score")


def strip_prompt(df: DataFrame, seq_col: str = "seq", input_len_col: str = "input_len", out: str = "gen_ids") -> DataFrame:
    """Generated ids only: ``seq[input_len:]``."""
    seq = F.col(seq_col)
    start = F.col(input_len_col) + 1
    return df.withColumn(out, F.slice(seq, start, F.greatest(F.size(seq) - F.col(input_len_col), F.lit(0))))
