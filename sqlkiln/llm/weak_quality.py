"""Quality without labels: overlapping heuristic labellers, their accuracies
by expectation-maximisation, and a hashed linear scorer trained on the
posterior labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sqlkiln.llm.common import chunks, spark_type

GOOD, ABSTAIN, BAD = 2, 1, 0
LABELLERS = ("length", "symbols", "capitals", "repeated_lines", "variety", "word_length", "top_word", "sentences",
             "letterless", "symbol_ends", "shouting")
EM_ROUNDS = 200
# Weights hash into so many buckets; the scorer is trained on about so many
# documents picked by a hash of their id.
BUCKETS = 1 << 16
SAMPLE_DOCS = 8_000
EPOCHS, RATE, RIDGE = 12, 0.5, 1e-6

_SHAPE = bytes.maketrans(
    bytes(range(256)), bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b
                             for b in range(256)))
_RUNS = re.compile(rb"(.)\1+")
_SYMBOLS = b"#*$%&|<>@^~=_"


@dataclass
class Text:
    """What the labellers and the scorer look at."""

    counts: Counter
    size: int
    lines: int
    distinct_lines: int
    symbols: int
    capitals: int
    letters: int
    length: int
    stops: int
    shapes: Counter
    letterless: int
    symbol_ends: int
    shouted: int


def look(data: bytes) -> Text:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    shape = Counter(data.translate(_SHAPE))
    counts, shapes = Counter(words), Counter()
    for w, c in counts.items():
        shapes[_RUNS.sub(rb"\1", w.translate(_SHAPE))] += c
    stops = letterless = symbol_ends = shouted = 0
    for x, c in shapes.items():
        upper, lower = b"A" in x, b"a" in x
        stops += c * (x[-1:] in b".!?")
        letterless += c * (not upper and not lower)
        symbol_ends += c * (x[-1:] not in b"aA0.,!?;:)'\"")
        shouted += c * (upper and not lower)
    return Text(counts, len(words), len(lines), len(set(lines)), len(data) - len(data.translate(None, _SYMBOLS)),
                shape[65], shape[65] + shape[97], sum(map(len, words)), stops, shapes, letterless, symbol_ends, shouted)


def votes(t: Text) -> list[int]:
    """One vote per labeller: good, bad, or no opinion."""
    n = max(t.size, 1)

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    top = max(t.counts.values(), default=0) / n
    variety, long_ = len(t.counts) / n, t.size >= 50
    return [
        vote(t.size < 5, t.size >= 50),
        vote(t.symbols > 0.1 * n, t.symbols < 0.01 * n and t.size > 0),
        vote(t.capitals > 0.3 * max(t.letters, 1), t.capitals < 0.1 * t.letters),
        vote(t.lines - t.distinct_lines > 0.3 * t.lines, t.lines >= 3 and t.lines == t.distinct_lines),
        vote(long_ and variety < 0.2, variety > 0.3),
        vote(t.size > 0 and not 2.5 <= t.length / n <= 7.5, 3.5 <= t.length / n <= 6.5),
        vote(long_ and top > 0.25, t.size >= 20 and top < 0.15),
        vote(long_ and (t.stops == 0 or t.stops > 0.5 * n), 0.02 * n <= t.stops <= 0.35 * n),
        vote(t.letterless > 0.2 * n, 0 < t.size and t.letterless < 0.05 * n),
        vote(t.symbol_ends > 0.2 * n, 0 < t.size and t.symbol_ends < 0.05 * n),
        vote(long_ and t.shouted > 0.4 * n, t.size >= 20 and t.shouted < 0.1 * n),
    ]


def features(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a text: its words, their shapes and a few bands of
    its proportions. Each group has length one."""
    n = max(t.size, 1)
    bands = [b"n%d" % min(12, t.size.bit_length()), b"v%d" % (10 * len(t.counts) // n),
             b"t%d" % (10 * max(t.counts.values(), default=0) // n), b"d%d" % (10 * t.distinct_lines // max(t.lines, 1)),
             b"l%d" % min(20, t.length // n), b"s%d" % min(20, 10 * t.symbols // n)]
    keys = [b"w" + w for w in t.counts] + [b"s" + s for s in t.shapes] + bands
    values = [(c / n) ** 0.5 for c in t.counts.values()] + [(c / n) ** 0.5 for c in t.shapes.values()]
    values += [len(bands) ** -0.5] * len(bands)
    return np.array([zlib.crc32(k) & (BUCKETS - 1) for k in keys], np.int32), np.array(values, np.float32)


@dataclass
class Labellers:
    """P(vote | class, voted) of every labeller and the share of good
    documents. Abstaining says nothing about the class."""

    table: np.ndarray  # (labellers, class, vote)
    good: float

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        """P(good | votes) of rows of votes."""
        logs = np.log([1 - self.good, self.good]) + sum(
            np.log(self.table[j][:, ballots[:, j]]).T for j in range(len(self.table)))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """P(vote is right | voted) per labeller, over both classes."""
        right = (1 - self.good) * self.table[:, 0, BAD] + self.good * self.table[:, 1, GOOD]
        return dict(zip(LABELLERS, right.tolist()))


def expectation_maximisation(ballots: np.ndarray, weight: np.ndarray, rounds: int = EM_ROUNDS) -> Labellers:
    """Fit to distinct ballots with their numbers of documents. It starts
    from labellers that are right more often than not, which decides what is
    called good; counts are smoothed by one document."""
    model = Labellers(np.tile(np.array([[0.6, 1.0, 0.4], [0.1, 1.0, 0.9]]), (ballots.shape[1], 1, 1)), 0.8)
    before = None
    for _ in range(rounds):
        good = model.posterior(ballots)
        both = np.stack([1 - good, good]) * weight
        counts = np.stack([np.stack([np.bincount(ballots[:, j], both[c], 3) for c in (0, 1)])
                           for j in range(ballots.shape[1])]) + 1.0
        cast = counts[:, :, [BAD, GOOD]].sum(axis=2, keepdims=True)
        table = counts / cast
        table[:, :, ABSTAIN] = 1.0
        model = Labellers(table, float((both[1].sum() + 1) / (weight.sum() + 2)))
        if before is not None and np.abs(good - before).max() < 1e-9:
            break
        before = good
    return model


@dataclass
class Model:
    labellers: Labellers
    weights: np.ndarray
    bias: float


def _pattern(ballot: list[int]) -> int:
    return sum(v * 3**j for j, v in enumerate(ballot))


def _ballots(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**j % 3 for j in range(len(LABELLERS))], axis=1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Every document votes; the driver gets one row per distinct ballot (at
    most 3 to the number of labellers). The scorer learns from the posterior
    labels of the sample. None for an empty table."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def poll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(_pattern(votes(look(t))) for _, piece in chunks(batch.column(0)) for t in piece)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                                             names=["ballot", "n"])

    polled = narrow.select("text").mapInArrow(poll, "ballot long, n long").groupBy("ballot").agg(F.sum("n").alias("n"))
    rows = polled.collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["ballot"])
    patterns, weight = np.array([r["ballot"] for r in rows]), np.array([r["n"] for r in rows], float)
    labellers = expectation_maximisation(_ballots(patterns), weight)
    share = min(1.0, SAMPLE_DOCS / weight.sum())
    unit = F.pmod(F.xxhash64(F.col("id").cast("string"), "text", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, piece in chunks(batch.column(0)):
                for data in piece:
                    text = look(data)
                    out.append((_pattern(votes(text)), *features(text)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int32())),
                     pa.array([o[2] for o in out], pa.list_(pa.float32()))], names=["ballot", "at", "value"])

    drawn = narrow.where(unit < share).select("text").mapInArrow(sample, "ballot long, at array<int>, value array<float>")
    got = drawn.toArrow()
    truth = labellers.posterior(_ballots(got.column("ballot").to_numpy())) if got.num_rows else np.zeros(0)
    at, value = got.column("at").combine_chunks(), got.column("value").combine_chunks()
    weights, bias = _train(np.asarray(at.offsets), np.asarray(at.values), np.asarray(value.values), truth)
    return Model(labellers, weights, bias)


def _train(offsets: np.ndarray, at: np.ndarray, value: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad, in mini-batches; the
    two classes weigh the same."""
    weights, sums = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    good = float(truth.mean()) if len(truth) else 0.5
    cost = truth / max(2 * good, 1e-3) + (1 - truth) / max(2 * (1 - good), 1e-3)
    bias, bias_sum, draw = 0.0, 1e-6, np.random.default_rng(0)
    order = np.arange(len(truth))
    for _ in range(EPOCHS):
        draw.shuffle(order)
        for first in range(0, len(order), 64):
            rows = order[first : first + 64]
            size = offsets[rows + 1] - offsets[rows]
            owner = np.repeat(np.arange(len(rows)), size)
            where = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[rows], size)
            keys, x = at[where], value[where]
            line = bias + np.bincount(owner, weights[keys] * x, len(rows))
            error = (truth[rows] - 1 / (1 + np.exp(-np.clip(line, -30, 30)))) * cost[rows] / len(rows)
            used, back = np.unique(keys, return_inverse=True)
            grad = np.bincount(back, error[owner] * x, len(used)) - RIDGE * weights[used]
            sums[used] += grad**2
            weights[used] += RATE * grad / np.sqrt(sums[used])
            bias_sum += error.sum() ** 2
            bias += RATE * error.sum() / bias_sum**0.5
    return weights.astype(np.float32), bias


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, weak, ballot)`` per document of the whole text: the
    linear score of good quality (0 to 1), the labellers' posterior, and the
    votes as one digit each (0 bad, 1 none, 2 good). Null is the empty text,
    and a text of any length counts whole, one at a time. Rows are kept one
    for one, so repeated and null ids and empty tables pass through; other
    columns play no part, whatever their names. Without a model the scores
    are null."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            value, ballots = np.zeros(batch.num_rows), []
            for first, piece in chunks(batch.column(1)):
                for i, data in enumerate(piece, first):
                    text = look(data)
                    ballots.append(votes(text))
                    if net:
                        at, x = features(text)
                        line = net.bias + float(net.weights[at] @ x)
                        value[i] = 1 / (1 + np.exp(-np.clip(line, -30, 30)))
            weak = net.labellers.posterior(np.array(ballots)) if net and ballots else value
            none = pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value) if net else none, pa.array(weak) if net else none,
                 pa.array(["".join(map(str, b)) for b in ballots], pa.string())], names=["id", "score", "weak", "ballot"])

    return narrow.mapInArrow(run, f"id {spark_type(narrow, 'id')}, score double, weak double, ballot string")
