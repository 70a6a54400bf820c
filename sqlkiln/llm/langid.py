"""Language identification of code-switched text: a linear-chain conditional
random field labels every word, and a document takes its largest share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sqlkiln.llm.common import chunks, spark_type

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
# Hashed weights of affixes (boundary-marked n-grams), n-grams and words: 2^18
# buckets, fewer when buckets x languages would pass 2^24 (over 64 languages).
BUCKET_BITS, WEIGHT_BITS = 18, 24
NGRAMS = (1, 2, 3, 4)
# The labelled sample: about so many documents of each language (all in all as
# many as for 64 languages, but 8 of each), and so many evenly spaced segments
# of so many words from each. Every language that has a document is learned.
SAMPLE_DOCS, SEGMENTS, SEGMENT_WORDS = 600, 4, 32
SAMPLE_LANGUAGES, LEAST_DOCS = 64, 8
SWITCH_RATE = 0.25
ITERATIONS, STEP, DECAY = 30, 0.5, 1e-4
BLOCK_WORDS = 256
# A longer chain is labelled in stretches of so many words, which bounds a
# worker's memory; messages are carried over from stretch to stretch.
STRETCH_WORDS = 1000 * BLOCK_WORDS
# Texts labelled at once.
LABEL_BYTES = 1 << 20

_KIND = np.arange(8, dtype=np.uint64) << np.uint64(40)
_ODD = (np.random.default_rng(7).integers(1, 1 << 62, 8).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets, languages)
    known: np.ndarray  # sorted word hashes of the lexicon
    lexicon: np.ndarray  # (len(known), languages), centred log shares
    trust: float  # learned weight of the lexicon feature
    moves: np.ndarray  # (languages, languages) transition scores
    start: np.ndarray


def text_words(data: bytes) -> list[bytes]:
    return [w.encode() for w in LETTERS.findall(data.decode("utf-8", "replace").lower())]


def bucket_bits(languages: int) -> int:
    return min(BUCKET_BITS, WEIGHT_BITS - (languages - 1).bit_length())


def features(found: list[bytes], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, word each belongs to, hash of each word) for
    distinct non-empty words: every byte n-gram of the word between boundary
    marks (those that touch a mark are its affixes) and the whole word."""
    buf = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in found), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 2
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(found)), size)
    left = np.repeat(first + size, size) - np.arange(len(buf))  # bytes to the end of the word
    buckets, owners, rolling = [], [], np.zeros(len(buf), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        rolling[: len(buf) - n + 1] += buf[n - 1 :] * _ODD[n - 1]
        if n in NGRAMS:
            whole = left >= n
            buckets.append(((rolling[whole] ^ _KIND[n]) * _ODD[6]) >> np.uint64(64 - bits))
            owners.append(owner[whole])
    at = np.arange(len(buf)) - np.repeat(first, size)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()), _ODD[5]))), dtype=np.uint64)
    hashes = np.add.reduceat((buf + np.uint64(1)) * power[at], first)
    buckets.append((hashes * _ODD[6]) >> np.uint64(64 - bits))
    owners.append(np.arange(len(found)))
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owners).astype(np.int32), hashes


def emissions(model: Model, found: list[bytes]) -> np.ndarray:
    """Scores (words, languages) of distinct words."""
    out = np.zeros((len(found), len(model.languages)))
    if not found:
        return out
    buckets, owners, hashes = features(found, bucket_bits(len(model.languages)))
    rows = model.weights[buckets]
    for s in range(out.shape[1]):
        out[:, s] = np.bincount(owners, rows[:, s], len(found))
    return out + model.trust * _lexicon(model, hashes)


def _lexicon(model: Model, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), len(model.languages)))
    if len(model.known):
        at = np.minimum(np.searchsorted(model.known, hashes), len(model.known) - 1)
        hit = model.known[at] == hashes
        out[hit] = model.lexicon[at[hit]]
    return out


class _Blocks:
    """A run of words cut into blocks that all step at once; blocks are filled
    up with words that begin chains of their own."""

    def __init__(self, scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, start: np.ndarray, block: int):
        self.n, self.k = scores.shape
        self.rows, self.block = -(-self.n // block), block
        fill = self.rows * block - self.n
        local = np.exp(scores - scores.max(axis=1, keepdims=True))
        self.local = np.concatenate([local, np.ones((fill, self.k))]).reshape(self.rows, block, self.k)
        self.fresh = np.concatenate([starts, np.ones(fill, bool)]).reshape(self.rows, block)
        self.move, self.begin = np.exp(moves - moves.max()), np.exp(start - start.max())
        carry = np.broadcast_to(np.eye(self.k), (self.rows, self.k, self.k))
        for t in range(block):
            carry = self.step(carry, t)
        self.carry = carry

    def step(self, v: np.ndarray, t: int) -> np.ndarray:
        """(rows, ..., k) row vectors over the word at t."""
        rows = self.rows
        on = self.fresh[:, t].reshape((rows,) + (1,) * (v.ndim - 1))
        v = np.where(on, v.sum(axis=-1, keepdims=True) * self.begin, v @ self.move)
        v = v * self.local[:, t].reshape((rows,) + (1,) * (v.ndim - 2) + (self.k,))
        return v / v.sum(axis=tuple(range(1, v.ndim)), keepdims=True)

    def transfer(self) -> np.ndarray:
        """The transfer matrix of the whole run."""
        whole = np.eye(self.k)
        for c in self.carry:
            whole = whole @ c
            whole = whole / whole.sum()
        return whole

    def marginals(self, enter: np.ndarray | None = None, leave: np.ndarray | None = None,
                  moved: np.ndarray | None = None) -> np.ndarray:
        rows, block, k = self.rows, self.block, self.k
        ahead, behind = np.full((rows, k), 1 / k), np.full((rows, k), 1 / k)
        if enter is not None:
            ahead[0] = enter
        if leave is not None:
            behind[-1] = leave
        for r in range(1, rows):
            v = ahead[r - 1] @ self.carry[r - 1]
            ahead[r] = v / v.sum()
            v = self.carry[rows - r] @ behind[rows - r]
            behind[rows - r - 1] = v / v.sum()
        forward = np.empty((block, rows, k))
        v = ahead
        for t in range(block):
            v = forward[t] = self.step(v, t)
        out = np.empty((rows, block, k))
        v = behind
        for t in range(block - 1, -1, -1):
            both = forward[t] * v
            out[:, t] = both / both.sum(axis=1, keepdims=True)
            v = v * self.local[:, t]
            if moved is not None:
                pair = (forward[t - 1] if t else ahead)[:, :, None] * self.move * v[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                moved += pair[~self.fresh[:, t]].sum(axis=0)
            v = np.where(self.fresh[:, t, None], (v @ self.begin)[:, None], v @ self.move.T)
            v = v / v.sum(axis=1, keepdims=True)
        return out.reshape(rows * block, k)[: self.n]


def marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, start: np.ndarray,
              block: int = BLOCK_WORDS, moved: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward: P(label | all words of its chain), shape of
    ``scores`` (words, labels). ``starts`` marks the first word of a chain
    (always the first row). Exact for chains of any length: the words are cut
    into blocks, the blocks' transfer matrices carry the messages over, and
    all blocks step at once. To ``moved`` (labels, labels) the expected number
    of each move inside a chain is added, from the same messages."""
    return _Blocks(scores, starts, moves, start, block).marginals(moved=moved)


def long_marginals(scores_of: Callable[[int, int], np.ndarray], n: int, moves: np.ndarray, start: np.ndarray,
                   stretch: int = STRETCH_WORDS, block: int = BLOCK_WORDS) -> Iterator[np.ndarray]:
    """The marginals of one chain of ``n`` words, stretch by stretch;
    ``scores_of(a, b)`` gives the scores of words a to b, and is asked twice.
    As exact as ``marginals`` over the whole chain: the transfer matrices of
    the stretches carry the messages both ways."""
    cuts = list(range(0, n, stretch // block * block)) + [n]

    def blocks(j: int) -> _Blocks:
        starts = np.zeros(cuts[j + 1] - cuts[j], bool)
        starts[0] = j == 0
        return _Blocks(scores_of(cuts[j], cuts[j + 1]), starts, moves, start, block)

    whole = [blocks(j).transfer() for j in range(len(cuts) - 1)] if len(cuts) > 2 else []
    enter: list[np.ndarray | None] = [None]
    leave: list[np.ndarray | None] = [None] * (len(cuts) - 1)
    for j in range(len(whole) - 1):
        v = (np.ones(len(start)) if enter[j] is None else enter[j]) @ whole[j]
        enter.append(v / v.sum())
    for j in range(len(whole) - 1, 0, -1):
        v = whole[j] @ (np.ones(len(start)) if leave[j] is None else leave[j])
        leave[j - 1] = v / v.sum()
    for j in range(len(cuts) - 1):
        yield blocks(j).marginals(enter[j], leave[j])


def train(segments: list[tuple[str, list[bytes]]], iterations: int = ITERATIONS) -> Model:
    """Fit on labelled segments by conditional likelihood (full-batch
    Adagrad). Chains are runs of segments; about ``SWITCH_RATE`` of the
    joints change language, so that the transitions learn switching."""
    languages = sorted({lang for lang, _ in segments})
    k = len(languages)
    code = {lang: s for s, lang in enumerate(languages)}
    draw = np.random.default_rng(0)
    by = [[w for lang, w in segments if lang == x] for x in languages]
    chains: list[list[tuple[int, list[bytes]]]] = []
    queues = [list(draw.permutation(len(x))) for x in by]
    now = 0
    while any(queues):
        if not chains or len(chains[-1]) == 4:
            chains.append([])
        if not queues[now] or draw.random() < SWITCH_RATE or not chains[-1]:
            open_ = [s for s in range(k) if queues[s]]
            now = open_[draw.integers(len(open_))]
        chains[-1].append((now, by[now][queues[now].pop()]))
    words_ = [w for chain in chains for _, seg in chain for w in seg]
    label = np.array([s for chain in chains for s, seg in chain for _ in seg])
    starts = np.concatenate([np.arange(sum(len(seg) for _, seg in chain)) == 0 for chain in chains])
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words_])
    size = 1 << bucket_bits(k)
    buckets, owners, hashes = features(list(index), bucket_bits(k))
    counts = np.bincount(ids * k + label, minlength=len(index) * k).reshape(-1, k)
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(index))
    often = np.flatnonzero(counts.sum(axis=1) >= 3)
    often = often[np.argsort(hashes[often])]
    logs = np.log(share[often])
    model = Model(languages, np.zeros((size, k)), hashes[often], logs - logs.mean(axis=1, keepdims=True),
                  0.1, np.zeros((k, k)), np.zeros(k))
    lex = _lexicon(model, hashes)
    truth = np.zeros((len(ids), k))
    truth[np.arange(len(ids)), label] = 1
    inner = ~starts[1:]
    seen_moves = np.bincount(label[:-1][inner] * k + label[1:][inner], minlength=k * k).reshape(k, k)
    sums = [np.zeros_like(model.weights), 0.0, np.zeros((k, k)), np.zeros(k)]
    n = len(ids)
    for _ in range(iterations):
        word_scores = np.stack([np.bincount(owners, model.weights[buckets, s], len(index)) for s in range(k)], axis=1)
        scores = (word_scores + model.trust * lex)[ids]
        moved = np.zeros((k, k))
        gamma = marginals(scores, starts, model.moves, model.start, moved=moved)
        error = (truth - gamma) / n
        by_word = np.stack([np.bincount(ids, error[:, s], len(index)) for s in range(k)], axis=1)
        grad_w = np.stack([np.bincount(buckets, by_word[owners, s], size) for s in range(k)], axis=1)
        grads = [grad_w - DECAY * model.weights / n, float((error * lex[ids]).sum()),
                 (seen_moves - moved) / n - DECAY * model.moves,
                 error[starts].sum(axis=0) - DECAY * model.start]
        for j, grad in enumerate(grads):
            sums[j] = sums[j] + np.square(grad)
            move = STEP * grad / (np.sqrt(sums[j]) + 1e-12)
            if j == 0:
                model.weights += move
            elif j == 1:
                model.trust = max(0.0, model.trust + 0.1 * move)
            elif j == 2:
                model.moves = model.moves + move
            else:
                model.start = model.start + move
    model.weights = model.weights.astype(np.float32)
    return model


def labelled_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      per_language: int = SAMPLE_DOCS) -> list[tuple[str, list[bytes]]]:
    """The bounded training sample: about ``per_language`` documents of each
    language, picked by a hash of id and text, each giving ``SEGMENTS`` evenly
    spaced segments of its whole text. With over ``SAMPLE_LANGUAGES`` languages
    each has fewer documents, about ``LEAST_DOCS`` at least, and none is left
    out: a language with few documents gives all it has."""
    named = docs.where(F.col(lang_col).isNotNull())
    sizes = named.groupBy(F.col(lang_col).cast("string").alias("lang")).count()
    sizes = sizes.collect()
    if not sizes:
        return []
    per_language = max(LEAST_DOCS, min(per_language, per_language * SAMPLE_LANGUAGES // len(sizes)))
    quota = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]) if r["count"] > 4 * LEAST_DOCS else 1.0)])
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    drawn = named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                         unit.alias("unit")).where(F.col("unit") < F.element_at(quota, F.col("lang")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out_lang, out_words = batch.column(0).to_pylist(), [], []
            for at, piece in chunks(batch.column(1)):
                for i, data in enumerate(piece, at):
                    found = text_words(data)
                    spread = max(1, len(found) - SEGMENT_WORDS)
                    for first in sorted({spread * j // SEGMENTS for j in range(SEGMENTS)}):
                        if segment := found[first : first + SEGMENT_WORDS]:
                            out_lang.append(langs[i])
                            out_words.append(b" ".join(segment).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out_words, pa.string())],
                                             names=["lang", "words"])

    rows = drawn.select("lang", "text").mapInArrow(cut, "lang string, words string").collect()
    return sorted((r["lang"], [w.encode() for w in r["words"].split(" ")]) for r in rows)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from labelled documents, or None when none has a language and
    a letter."""
    segments = labelled_segments(docs, id_col, text_col, lang_col)
    return train(segments) if segments else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, lang_pred, score, n_letter_words, n_switches)`` per document.

    Every word of the whole text gets its posterior over languages by
    forward-backward; the document's language is the one with the largest
    expected number of words (ties: the first in name order) and ``score``
    its share. ``n_switches`` counts neighbours whose likeliest labels
    differ. Null text, or text without a letter: ``und`` with score 0. Rows
    are kept one for one, so repeated ids, null ids and empty tables pass
    through; ``keep`` names columns to carry along."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            rows = batch.num_rows
            lang, score = [UNKNOWN] * rows, np.zeros(rows)
            count, switches = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for i, share, words_, turns in _documents(net, batch.column(1)):
                top = int(share.argmax())
                lang[i], score[i], count[i], switches[i] = net.languages[top], min(1.0, share[top]), words_, turns
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(count), pa.array(switches)],
                names=["id", "lang_pred", "score", "n_letter_words", "n_switches"])

    return narrow.mapInArrow(
        run, f"id {spark_type(narrow, 'id')}, lang_pred string, score double, n_letter_words long, n_switches long")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a share of at
    least ``least``; columns unchanged. Row-local, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identified(texts: pa.Array) -> pa.Array:
        ok = np.zeros(len(texts), bool)
        for i, share, _, _ in _documents(shared.value, texts):
            ok[i] = share.max() >= least
        return pa.array(ok)

    return docs.where(F.arrow_udf(identified, "boolean")(F.col(text_col).cast("string")))


def _documents(net: Model | None, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(row, language shares, words, switches) of every text with a letter."""
    for at, piece in chunks(texts, LABEL_BYTES) if net else ():
        found = [text_words(data) for data in piece]
        if len(piece) == 1 and len(found[0]) > STRETCH_WORDS:
            yield at, *_stretches(net, found[0])
        else:
            for i, share, size, turns in _chains(net, found):
                yield at + i, share, size, turns


def _stretches(net: Model, words_: list[bytes]) -> tuple[np.ndarray, int, int]:
    """(language shares, words, switches) of one very long text."""
    def scores(a: int, b: int) -> np.ndarray:
        index: dict[bytes, int] = {}
        ids = np.array([index.setdefault(w, len(index)) for w in words_[a:b]])
        return emissions(net, list(index))[ids]

    total, turns, last = np.zeros(len(net.languages)), 0, None
    for gamma in long_marginals(scores, len(words_), net.moves, net.start, STRETCH_WORDS):
        best = gamma.argmax(axis=1)
        turns += int((best[1:] != best[:-1]).sum()) + (last is not None and best[0] != last)
        last = best[-1]
        total += gamma.sum(axis=0)
    return total / len(words_), len(words_), int(turns)


def _chains(net: Model, texts: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """Label the words of each text as one chain."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for text in texts for w in text], np.int64)
    size = np.array([len(text) for text in texts], np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return
    first = np.concatenate(([0], np.cumsum(size[full])[:-1]))
    starts = np.zeros(len(ids), bool)
    starts[first] = True
    gamma = marginals(emissions(net, list(index))[ids], starts, net.moves, net.start)
    best = gamma.argmax(axis=1)
    turns = np.concatenate(([False], best[1:] != best[:-1])) & ~starts
    share = np.add.reduceat(gamma, first, axis=0) / size[full][:, None]
    switched = np.add.reduceat(turns.astype(np.int64), first)
    yield from zip(full.tolist(), share, size[full].tolist(), switched.tolist())
