"""Toxicity by maximum-scoring segments: token log-odds with Dirichlet
priors, a linear-time scan for every maximal segment, and extreme-value
calibration of the segments into one probability."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sqlkiln.batches import sizes
from sqlkiln.llm.common import chunks, row_pieces, spark_type
from sqlkiln.session import DEFAULT_BROADCAST_BYTES, broadcast_if_small, materialize, measured_bytes, shared_dir

LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_WORDS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 32 for c in range(256))
# A word's prior is that of the words that begin alike.
STEM = 4
# Pseudo-counts (documents) of a stem's and of a word's Dirichlet prior.
STEM_PRIOR, WORD_PRIOR = 8.0, 4.0
# Words and stems with at least this share of all (document, word) incidences
# go to the workers, at most so many of each; the others are joined by key.
MOST_TOKENS = 200_000
# Log-odds nearer to zero than this are neutral; every token costs DRIFT, so
# that the expected score of ordinary text is negative.
NEUTRAL, DRIFT = 1.0, 0.5
CALIBRATION_DOCS = 20_000
# A task counts words over so much text, or until it holds so many.
COUNT_BYTES, COUNT_WORDS = 16 * 1024 * 1024, 1 << 17
SIGNIFICANCE = 0.01


@dataclass
class Model:
    """``words`` and ``stems`` hold the frequent tokens, neutral ones
    included; ``rest`` is the written table ``(key, odds)`` of all others that
    are not what their stem says, or not neutral."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rest: DataFrame | None = None
    location: float = 0.0
    spread: float = 1.0
    weights: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)


@cache
def _letter_table() -> np.ndarray:
    """Whether a code point is one of ``LETTERS``."""
    table = np.zeros(0x110000, bool)
    for m in LETTERS.finditer("".join(map(chr, range(len(table))))):
        table[m.start() : m.end()] = True
    return table


def letter_words(data: bytes) -> list[str]:
    """The runs of letters of a text in lower case, as ``LETTERS`` finds them."""
    if data.isascii():
        return data.translate(_ASCII_WORDS).decode("ascii").split()
    points = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le"), "<u4")
    return np.where(_letter_table()[points], points, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le").split()


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), values)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _split(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, one array a row."""
    return np.split(_flat(column), np.cumsum(sizes(column))[:-1])


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """Every maximal scoring segment as (score, first, end), in order: the
    segments that no extension and no larger segment improves, found by one
    linear scan that keeps a stack of candidates. Only positive scores are
    visited; what lies between enters through the running sums."""
    ends = np.cumsum(scores)
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    gains = np.flatnonzero(scores > 0)
    for i, after, own in zip(gains.tolist(), ends[gains].tolist(), scores[gains].tolist()):
        candidate = (after - own, after, i, i + 1)
        while True:
            below = len(stack) - 1
            while below >= 0 and stack[below][0] >= candidate[0]:
                below -= 1
            if below < 0 or stack[below][1] >= candidate[1]:
                stack.append(candidate)
                break
            candidate = (stack[below][0], candidate[1], stack[below][2], candidate[3])
            del stack[below:]
    return [(after - before, first, end) for before, after, first, end in stack]


def summary(model: Model, segments: list[tuple[float, int, int]], size: int) -> tuple[float, float, float]:
    """The evidence of a text: the reduced extreme-value variate of its best
    segment, and log sums of the segments that beat what the best segment of
    an ordinary text of this length scores."""
    base = math.log(max(size, 1)) + model.location
    z = [(score - base) / model.spread for score, _, _ in segments]
    over = [x for x in z if x > 0]
    best = max(z, default=-base / model.spread)
    return max(-10.0, min(50.0, best)), math.log1p(sum(over)), math.log1p(len(over))


def scan(texts: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``texts`` with ``size`` (words), ``at`` and ``odds`` (places of the
    words that are not neutral, and their log-odds) instead of the text.

    Frequent words are looked up in the worker. The other words of a text are
    joined with the written table, by word and, when the worker does not know
    the stem, by stem; so only they are shuffled, never a text."""
    others = [c for c in texts.columns if c != text_col]
    where = texts.columns.index(text_col)
    shared = texts.sparkSession.sparkContext.broadcast((model.words, model.stems))
    joins = model.rest is not None

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = shared.value
        for batch in batches:
            for first, piece in chunks(batch.column(where)):
                found: list[str] = []
                size = np.zeros(len(piece), np.int64)
                for k, data in enumerate(piece):
                    said = letter_words(data)
                    size[k] = len(said)
                    found += said
                value = np.fromiter(map(words.get, found, repeat(math.nan if joins else 0.0)), np.float64, len(found))
                text = np.repeat(np.arange(len(piece)), size)
                place = (np.arange(len(found)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                unknown = np.isnan(value)
                sure = ~unknown & (value != 0)
                rare, rare_count, nth, at_text = [], np.zeros(len(piece), np.int64), [], -1
                index: dict[str, int] = {}
                for i, k in zip(np.flatnonzero(unknown).tolist(), text[unknown].tolist()):
                    if k != at_text:
                        index, at_text = {}, k
                    w = found[i]
                    at = index.setdefault(w, len(index))
                    if at == rare_count[k]:
                        rare.append(w)
                        rare_count[k] += 1
                    nth.append(at)
                known = [stems.get(w[:STEM]) if len(w) > STEM else 0.0 for w in rare]
                placed, opened = np.bincount(text[sure], minlength=len(piece)), np.bincount(text[unknown], minlength=len(piece))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)).slice(first, len(piece)) for c in others],
                     pa.array(size), _lists(placed, pa.array(place[sure])), _lists(placed, pa.array(value[sure])),
                     _lists(rare_count, pa.array(rare, pa.string())), _lists(rare_count, pa.array(known, pa.float64())),
                     _lists(opened, pa.array(place[unknown])), _lists(opened, pa.array(nth, pa.int32()))],
                    names=[*others, *names])

    names = ["size", "at", "odds", "rare", "known", "open_at", "open_nth"]
    head = [f"`{c}` {spark_type(texts, c)}" for c in others]
    rows = texts.mapInArrow(look, ", ".join([
        *head, "size long, at array<int>, odds array<double>, rare array<string>, known array<double>, "
               "open_at array<int>, open_nth array<int>"]))
    if not joins:
        return rows.select(*others, "size", "at", "odds")
    path = shared_dir(texts.sparkSession, "toxicity")  # compressed, unlike a checkpoint
    rows.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = texts.sparkSession.read.parquet(path)
    asked = rows.select("row", F.posexplode(F.arrays_zip("rare", "known")).alias("nth", "ask"))
    stem = F.when(F.col("ask.known").isNull(), F.concat(F.lit("s"), F.substring("ask.rare", 1, STEM)))
    keys = F.array_compact(F.array(F.concat(F.lit("w"), F.col("ask.rare")), stem))
    asked = asked.select("row", "nth", F.explode(keys).alias("asked"))
    rest = F.broadcast(model.rest) if measured_bytes(model.rest) <= DEFAULT_BROADCAST_BYTES else model.rest
    met = asked.join(rest, F.col("asked") == F.col("key"))
    met = met.groupBy("row").agg(F.collect_list(F.struct(
        "nth", F.col("key").startswith("w").alias("own"), F.col("odds").alias("value"))).alias("met"))
    # As long as the table: no broadcast, whatever its size now.
    met = met.withColumnRenamed("row", "of_row")
    rows = rows.join(met, F.col("row") == F.col("of_row"), "left").select(
        *others, "size", "at", "odds", "known", "open_at", "open_nth", "met")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in row_pieces(b, "size")):
            size, at, odds, known, open_at, open_nth, met = (batch.column(len(others) + k) for k in range(7))
            row = np.arange(batch.num_rows)
            value = pc.fill_null(known.flatten(), 0.0).to_numpy(zero_copy_only=False).copy()
            begin = np.cumsum(sizes(known)) - sizes(known)
            entry = met.flatten()
            nth, own, entered = (entry.field(k).to_numpy(zero_copy_only=False) for k in ("nth", "own", "value"))
            spot = np.repeat(begin, sizes(met)) + nth
            for last in (False, True):  # the word's own entry comes last
                value[spot[own == last]] = entered[own == last]
            opened = value[np.repeat(begin, sizes(open_at)) + _flat(open_nth)]
            text = np.concatenate([np.repeat(row, sizes(at)), np.repeat(row, sizes(open_at))[opened != 0]])
            order = np.argsort(text, kind="stable")
            count = np.bincount(text, minlength=len(row))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(others))], size,
                 _lists(count, pa.array(np.concatenate([_flat(at), _flat(open_at)[opened != 0]])[order], pa.int32())),
                 _lists(count, pa.array(np.concatenate([_flat(odds), opened[opened != 0]])[order], pa.float64()))],
                names=[*others, "size", "at", "odds"])

    return rows.mapInArrow(fill, ", ".join([*head, "size long, at array<int>, odds array<double>"]))


def segments_of(size: int, at: np.ndarray, odds: np.ndarray) -> list[tuple[float, int, int]]:
    """The maximal segments of a text from its words that are not neutral."""
    scores = np.full(size, -DRIFT)
    scores[at] += odds
    return maximal_segments(scores) if size else []


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """``(text, toxic, half)`` of the labelled documents. Labels that
    contradict each other count as toxic; null labels are none."""
    each = labels.select(F.col(label_id).alias("key"), F.col(label_col).alias("label")).where(
        "key is not null and label is not null").groupBy("key").agg((F.max("label") > 0).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(broadcast_if_small(each), F.col("id") == F.col("key"))
    return joined.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


def incidences(rows: DataFrame) -> DataFrame:
    """``(word, t0, c0, t1, c1)``: toxic and clean documents with the word,
    by half; counted within a task first, then summed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [Counter() for _ in range(4)], 0
        for batch in batches:
            toxic, half = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, piece in chunks(batch.column(0)):
                for i, data in enumerate(piece, at):
                    seen[2 * half[i] + (not toxic[i])].update(set(letter_words(data)))
                    held += len(data)
                if held > COUNT_BYTES or sum(map(len, seen)) > COUNT_WORDS:
                    yield _summed(seen)
                    seen, held = [Counter() for _ in range(4)], 0
        yield _summed(seen)

    counted = rows.mapInArrow(count, "word string, t0 long, c0 long, t1 long, c1 long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])


def _summed(seen: list[Counter]) -> pa.RecordBatch:
    every = list(set().union(*seen))
    return pa.RecordBatch.from_arrays(
        [pa.array(every, pa.string()),
         *[pa.array(np.fromiter(map(s.get, every, repeat(0)), np.int64, len(every))) for s in seen]],
        names=["word", "t0", "c0", "t1", "c1"])


def log_odds(counts: DataFrame, halves: tuple[int, ...]) -> Model | None:
    """Log-odds of words and of stems, relative to all tokens. A stem's share
    of toxic incidences has a Dirichlet prior at the overall share, a word's
    at the share of its stem. Every word has its log-odds, however rare: the
    frequent ones (at most ``MOST_TOKENS`` words and as many stems) are read
    into the model, the others stay in a written table."""
    t, c = (sum(F.col(f"{x}{h}") for h in halves) for x in "tc")
    words = counts.select("word", t.alias("t"), (t + c).alias("n")).where("n > 0")
    total = words.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()[0]
    if not total["t"] or total["t"] == total["n"]:
        return None
    share = total["t"] / total["n"]
    least = total["n"] / MOST_TOKENS

    def odds(p: F.Column) -> F.Column:
        found = F.log(p / (1 - p)) - math.log(share / (1 - share))
        return F.when(F.abs(found) >= NEUTRAL, found).otherwise(0.0)

    stem = F.when(F.length("word") > STEM, F.substring("word", 1, STEM)).otherwise(F.lit(""))
    stems = words.groupBy(stem.alias("stem")).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # Written out, so that the join below deals both sides anew and Spark can
    # split the words of a frequent stem.
    stems = materialize(stems.withColumn("p", F.when(F.col("stem") == "", share).otherwise(
        (F.col("t") + STEM_PRIOR * share) / (F.col("n") + STEM_PRIOR))))
    joined = words.withColumn("of", stem).join(stems.select(F.col("stem").alias("of"), F.col("p").alias("prior")), "of")
    p = (F.col("t") + WORD_PRIOR * F.col("prior")) / (F.col("n") + WORD_PRIOR)
    # A rare word needs an entry only when it differs from what its stem says.
    word_rows = joined.select(F.concat(F.lit("w"), "word").alias("key"), "n", odds(p).alias("odds"),
                              ((odds(p) != 0) | (odds(F.col("prior")) != 0)).alias("needed"))
    stem_rows = stems.where("stem <> ''").select(F.concat(F.lit("s"), "stem").alias("key"), "n", odds(F.col("p")).alias("odds"),
                                                 (odds(F.col("p")) != 0).alias("needed"))
    every = materialize(word_rows.unionAll(stem_rows).where(F.col("needed") | (F.col("n") >= least)))
    model = Model()
    often = every.where(F.col("n") >= least).select("key", "odds").toArrow()
    for key, value in zip(often.column(0).to_pylist(), often.column(1).to_pylist()):
        (model.words if key[0] == "w" else model.stems)[key[1:]] = value
    model.rest = every.where(F.col("n") < least).select("key", "odds")
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic") -> Model | None:
    """Learn from all labelled documents of ``docs``: token log-odds from all
    of them; the extreme-value law of ordinary texts and the final logistic
    step from at most about ``CALIBRATION_DOCS`` texts of one half, scored
    with the log-odds of the other half alone. None when either class is
    missing."""
    rows = materialize(labelled(docs, labels, id_col, text_col, label_id, label_col))
    counts = materialize(incidences(rows))
    model = log_odds(counts, (0, 1))
    if model is None:
        return None
    half = log_odds(counts, (0,)) or Model()
    other = rows.where("half = 1")
    share = min(1.0, CALIBRATION_DOCS / max(1, other.count()))
    unit = F.pmod(F.xxhash64("text", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in row_pieces(b, "size")):
            size, at, odds = batch.column(1).to_pylist(), _split(batch.column(2)), _split(batch.column(3))
            scores = [[s for s, _, _ in segments_of(*x)] for x in zip(size, at, odds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.list_(pa.float64())), batch.column(1)],
                names=["toxic", "scores", "size"])

    drawn = scan(other.where(unit < share).select("toxic", "text"), half, "text")
    drawn = materialize(drawn.mapInArrow(segments, "toxic boolean, scores array<double>, size long"))
    # The driver gets one number a text, then the summary of each.
    best = drawn.where("not toxic").select(F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("s"), "size").collect()
    clean = np.array([r["s"] - math.log(max(r["size"], 1)) for r in best])
    if len(clean):
        model.spread = max(0.25, float(clean.std()) * math.sqrt(6) / math.pi)
        model.location = float(clean.mean()) - 0.5772156649 * model.spread
    law = Model(location=model.location, spread=model.spread)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in row_pieces(b, "size")):
            scores, size = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [summary(law, [(s, 0, 0) for s in x], n) for x, n in zip(scores, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(f) for f in found], pa.list_(pa.float64()))],
                                             names=["toxic", "facts"])

    got = drawn.mapInArrow(summaries, "toxic boolean, facts array<double>").collect()
    facts = np.array([r["facts"] for r in got])
    truth = np.array([bool(r["toxic"]) for r in got])
    model.weights = _logistic(facts, truth)
    return model


def _logistic(facts: np.ndarray, truth: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    if not len(truth) or truth.all() or not truth.any():
        return (-6.0, 0.1, 2.0, 2.0)  # no second half to learn from: a significant passage decides
    x = np.concatenate([np.ones((len(facts), 1)), facts], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (truth - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w + move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return tuple(w.tolist())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, n_words, passages)`` per document of the whole text.

    ``passages`` lists every significant toxic passage (p-value under
    ``SIGNIFICANCE`` by the extreme-value law for the text's length) as first
    word, end word and segment score; words are runs of letters. Null and
    empty texts have no segment and the lowest score; a text of any length is
    scored whole, by itself. Without a model every score is 0. Rows are kept
    one for one, so repeated and null ids and empty tables pass through, and
    columns of ``docs`` besides id and text play no part, whatever their
    names."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = f"id {spark_type(narrow, 'id')}"
    if model is None:
        return narrow.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"),
                             F.array().cast("array<struct<first:bigint,end:bigint,score:double>>").alias("passages"))
    shared = docs.sparkSession.sparkContext.broadcast((model.location, model.spread, model.weights))
    least = -math.log(-math.log1p(-SIGNIFICANCE))
    passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        location, spread, weights = shared.value
        net = Model(location=location, spread=spread, weights=weights)
        for batch in (piece for b in batches for piece in row_pieces(b, "size")):
            value, found = np.zeros(batch.num_rows), [[]] * batch.num_rows
            size, at, odds = batch.column(1).to_pylist(), _split(batch.column(2)), _split(batch.column(3))
            for i, n in enumerate(size):
                segments = segments_of(n, at[i], odds[i])
                facts = summary(net, segments, n)
                line = weights[0] + sum(w * f for w, f in zip(weights[1:], facts))
                value[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, line))))
                limit = math.log(max(n, 1)) + location + least * spread
                found[i] = [{"first": a, "end": b, "score": s} for s, a, b in segments if s >= limit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value), batch.column(1), pa.array(found, pa.list_(passage))],
                names=["id", "score", "n_words", "passages"])

    return scan(narrow, model, "text").mapInArrow(
        run, f"{kind}, score double, n_words long, passages array<struct<first:bigint,end:bigint,score:double>>")
