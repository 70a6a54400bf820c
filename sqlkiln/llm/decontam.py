"""Benchmark decontamination: rare pairs of neighbouring words join passages of
the corpus to test items, a bound that no reportable alignment misses picks the
passages, and Smith-Waterman alignment scores each of them.

Rarity is a prefix filter. A seed is a pair of words of an item; the seeds that
an alignment uses weigh at least its score less two. So the most frequent seeds
of an item, as many as together weigh too little for any report, need not be
looked up: whatever is reported uses at least one of the rarer ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sqlkiln.llm.common import chunks, row_key, spark_type, unused_name
from sqlkiln.session import broadcast_if_small, materialize

MATCH, MISMATCH, GAP = 2, -1, -1
# A pair is reported from this share of the item's own score, or, for long
# items, from a score of thirty matching words.
LEAST_RATIO, LONG_SCORE = 0.45, 60
LEAST_ITEM_WORDS = 5
# Items go to the workers in blocks of at most so many words.
BLOCK_WORDS = 2_000_000
PIECE = 1 << 20
# So many seed hits are handled at once; longer windows of a text are cut, with
# an overlap that holds any alignment.
MOST_HITS = 1 << 20
WINDOW_ITEMS = 64

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = (np.random.default_rng(11).integers(1, 1 << 62, 8).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE, np.uint64(base)))), dtype=np.uint64)


_POWER = _powers(int(_ODD[0]))
_INVERSE = _powers(pow(int(_ODD[0]), -1, 1 << 64))


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of every word of folded text: a run of
    letters, digits or non-ASCII bytes. Handled in pieces cut between words;
    a word over ``PIECE`` bytes counts as several."""
    buf = np.frombuffer(data, np.uint8)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(buf):
        to = min(len(buf), at + PIECE)
        inside = _WORD_BYTE[buf[at:to]]
        if to < len(buf) and inside[-1] and len(gaps := np.flatnonzero(~inside)):
            to = at + int(gaps[-1]) + 1
            inside = inside[: to - at]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((buf[at:to] + np.uint64(1)) * _POWER[: to - at])))
        h = (sums[end] - sums[start]) * _INVERSE[start]
        out.append((start + at, end + at, (h ^ (h >> np.uint64(31))) * _ODD[1]))
        at = to
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def pair_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, next to each other) of every two neighbouring words and
    of every two words with one between them."""
    found = [(words[:-k], words[k:]) for k in (1, 2) if len(words) > k]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    total = np.concatenate([(x * _ODD[2] + y) * _ODD[2] for x, y in found])
    place = np.concatenate([np.arange(len(x)) for x, _ in found])
    return total ^ (total >> np.uint64(29)), place, np.arange(len(place)) < len(words) - 1


@dataclass
class Items:
    """A block of test items, indexed by seed. ``item`` and ``place`` list the
    occurrences of all seeds, sorted by seed and item; ``rare_*`` those that
    are looked up."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted distinct seed hashes
    first: np.ndarray  # CSR of each seed's occurrences
    item: np.ndarray
    place: np.ndarray
    next: np.ndarray  # whether the two words stand next to each other
    need: np.ndarray  # least weight of seeds, by item
    filter: np.ndarray  # membership table of the seeds' low bits
    rare_first: np.ndarray
    rare_item: np.ndarray
    rare_place: np.ndarray

    @staticmethod
    def of(rows: list[tuple], least: float = LEAST_RATIO) -> Items:
        """The index with all seeds looked up; ``ranked`` leaves out the
        frequent ones."""
        ids, words, seed, item, place, near = [], [], [], [], [], []
        for key, text in rows:
            hashes = word_hashes(folded(text))[2]
            if len(hashes) < LEAST_ITEM_WORDS:
                continue
            grams, at, beside = pair_hashes(hashes)
            seed.append(grams)
            item.append(np.full(len(grams), len(ids)))
            place.append(at)
            near.append(beside)
            ids.append(key)
            words.append(hashes)
        none = np.zeros(0, np.int64)
        if not ids:
            start = np.zeros(1, np.int64)
            return Items([], [], np.zeros(0, np.uint64), start, none, none, none, none, np.zeros(2, bool), start, none, none)
        seed_, item_, place_ = np.concatenate(seed), np.concatenate(item), np.concatenate(place)
        order = np.lexsort((place_, item_, seed_))
        seeds, first = np.unique(seed_[order], return_index=True)
        bits = max(16, int(len(seeds) * 16).bit_length())
        table = np.zeros(1 << bits, bool)
        table[(seeds & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        least_score = np.array([min(least * MATCH * len(w), LONG_SCORE) for w in words])
        first = np.append(first, len(order))
        return Items(ids, words, seeds, first, item_[order], place_[order], np.concatenate(near)[order],
                     least_score - 2 - 1e-9, table, first, item_[order], place_[order])

    def ranked(self, counts: np.ndarray) -> Items:
        """Look up only the rarer seeds, by their ``counts`` in the corpus: of
        each item the most frequent seeds are left out as long as they weigh
        less than a report needs, two for a place whose neighbouring words are
        among them, else one."""
        seed = np.repeat(np.arange(len(self.seeds)), np.diff(self.first))
        order = np.lexsort((seed, -counts[seed], self.item))
        ends = np.cumsum(np.bincount(self.item, minlength=len(self.ids)))
        kept = np.ones(len(seed), bool)
        for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
            weight: dict[int, int] = {}
            total = 0
            for o in order[a:b].tolist():
                at, w = int(self.place[o]), 1 + int(self.next[o])
                total += max(0, w - weight.get(at, 0))
                if total >= self.need[i]:
                    break
                weight[at] = max(w, weight.get(at, 0))
                kept[o] = False
        first = np.append(0, np.cumsum(np.bincount(seed[kept], minlength=len(self.seeds))))
        return replace(self, rare_first=first, rare_item=self.item[kept], rare_place=self.place[kept])


def _hits(items: Items, texts: list[bytes]) -> tuple:
    """The seeds of all items in some texts, in order of place: (text, place,
    next to each other, seed) and the words they lie in."""
    data = [folded(t.decode("utf-8", "replace")) for t in texts]
    begin = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
    start, end, words = word_hashes(big := b"\n".join(data))
    grams, pos, near = pair_hashes(words)
    maybe = np.flatnonzero(items.filter[(grams & np.uint64(len(items.filter) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.seeds, grams[maybe]), len(items.seeds) - 1)
    hit = items.seeds[at] == grams[maybe]
    pos, near, seed = pos[maybe[hit]], near[maybe[hit]], at[hit]
    doc = np.searchsorted(begin, start[pos], "right") - 1
    whole = np.searchsorted(begin, start[pos + 2 - near], "right") - 1 == doc
    order = np.flatnonzero(whole)[np.argsort(pos[whole], kind="stable")]
    return doc[order], pos[order], near[order], seed[order], words, start, end, begin, big


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range each belongs to, members) of the integer ranges that start at
    ``begin``, all in one."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner]


def _parts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of about ``most`` in all, of one member at least."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def passages(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray, bytes]]:
    """(text, item, first word, word hashes, passage) for every cluster of
    seed hits that may hold a reportable alignment: hits of one item whose
    implied item starts lie within an item length of each other, widened by a
    quarter of the item on both sides. Clusters much longer than the item are
    cut into overlapping windows.

    A seed is two words with at most one word between them, in the item and
    in the text. Of the steps from one matched word to the next, those with
    no edit add two to an alignment's score, those with one edit add one, and
    all others nothing; the first two are seed hits. So the hits of distinct
    item places, weighted two and one, come to at least the score less two,
    and clusters below that hold nothing to report.

    Only hits of rare seeds are matched with the items that look them up. An
    alignment has fewer gaps than twice the item's words, or its score would
    not be positive, so the other seeds of one that holds a rare hit are found
    in a window of two item lengths around it. Hits are handled in parts, so
    that neither a long text nor a seed of many items needs much memory."""
    doc, pos, near, seed, words, start, end, begin, big = _hits(items, texts)
    low, high = np.searchsorted(start, begin[:-1]), np.searchsorted(start, begin[1:])
    size = np.array([len(w) for w in items.words])
    fan = items.rare_first[seed + 1] - items.rare_first[seed]
    rare = np.flatnonzero(fan)
    for a, b in _parts(fan[rare], MOST_HITS):
        some = rare[a:b]
        rep, occ = _ranges(items.rare_first[seed[some]], fan[some])
        item, where = items.rare_item[occ], some[rep]
        origin = pos[where] - items.rare_place[occ]
        for d, i, left, right in _windows(items, size, doc, pos, near, seed, doc[where], item, origin, low, high):
            length, slack = int(size[i]), int(size[i]) // 4 + 2
            left, right = max(int(low[d]), left - slack), min(int(high[d]), right + length + slack)
            for first in range(left, max(left + 1, right - 2 * length), 2 * length):
                to = min(right, first + 4 * length)
                yield d, i, first - int(low[d]), words[first:to], big[start[first] : end[to - 1]]


def _windows(items: Items, size: np.ndarray, doc: np.ndarray, pos: np.ndarray, near: np.ndarray, seed: np.ndarray,
             of: np.ndarray, item: np.ndarray, origin: np.ndarray, low: np.ndarray, high: np.ndarray
             ) -> Iterator[tuple[int, int, int, int]]:
    """The clusters around rare hits ``(of, item, origin)``: all hits of the
    item in the windows around them are gathered and weighed."""
    order = np.lexsort((origin, item, of))
    of, item, origin = of[order], item[order], origin[order]
    reach = 3 * size[item]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | (origin[1:] - origin[:-1] > 2 * reach[1:])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(new)) - 1
    of, item = of[at], item[at]
    left = np.maximum(low[of], origin[at] - reach[at])
    right = np.minimum(high[of], origin[last] + reach[at] + size[item])
    # Cut what is long, with an overlap that holds any alignment.
    step, lap = WINDOW_ITEMS * size[item], 8 * size[item]
    cut, k = _ranges(np.zeros(len(of), np.int64), np.maximum(1, -(-(right - left) // step)))
    of, item = of[cut], item[cut]
    begin = left[cut] + k * step[cut]
    stop = np.minimum(right[cut], begin + step[cut] + lap[cut])
    first, ends = np.searchsorted(pos, begin), np.searchsorted(pos, stop)
    key = np.repeat(np.arange(len(items.seeds)), np.diff(items.first)) * len(items.ids) + items.item
    for a, b in _parts(ends - first, MOST_HITS):
        window, hit = _ranges(first[a:b], ends[a:b] - first[a:b])
        window += a
        mine = seed[hit] * len(items.ids) + item[window]
        begins, stops = np.searchsorted(key, mine), np.searchsorted(key, mine, "right")
        rep, occ = _ranges(begins, stops - begins)
        window, hit = window[rep], hit[rep]
        for w, x, y in _clusters(size, items, window, item[window], items.place[occ], 1 + (near[hit] & items.next[occ]), pos[hit] - items.place[occ]):
            yield int(of[w]), int(item[w]), x, y


def _clusters(size: np.ndarray, items: Items, window: np.ndarray, item: np.ndarray, place: np.ndarray,
              weight: np.ndarray, origin: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(window, first and last implied start) of the clusters with enough
    weight."""
    order = np.lexsort((origin, window))
    window, item, place, weight, origin = window[order], item[order], place[order], weight[order], origin[order]
    if not len(order):
        return
    new = np.ones(len(order), bool)
    new[1:] = (window[1:] != window[:-1]) | (origin[1:] - origin[:-1] > size[item[1:]])
    cluster = np.cumsum(new) - 1
    # The best hit of each item place, summed by cluster.
    order = np.lexsort((-weight, place, cluster))
    c, p = cluster[order], place[order]
    best = np.ones(len(order), bool)
    best[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    held = np.bincount(c[best], weight[order][best])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    for k in np.flatnonzero(held >= items.need[item[first]]).tolist():
        yield int(window[first[k]]), int(origin[first[k]]), int(origin[last[k]])


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, end in a, end in b) of the best local alignment, one numpy row
    per element of ``a``; ends are exclusive. Ties: the earliest."""
    slope = np.arange(len(b) + 1) * -GAP
    row, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, x in enumerate(a, 1):
        step = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP)
        here = np.concatenate(([0], np.maximum(step, 0)))
        row = np.maximum.accumulate(here + slope) - slope
        top = int(row.argmax())
        if row[top] > best[0]:
            best = int(row[top]), i, top
    return best


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment of an item in a
    passage, as a half-open range of passage words; the start is found by
    aligning backwards from the end."""
    score, i, j = smith_waterman(item, passage)
    if not score:
        return 0, 0, 0
    _, _, back = smith_waterman(item[:i][::-1], passage[:j][::-1])
    return score, j - back, j


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text",
          least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``(id, item, score, ratio, first_word, last_word, passage)``: the best
    alignment of each contaminated (document, item) pair.

    The pairs of neighbouring words of every item, or of two with a word
    between them, are counted over all texts; the rarer ones are looked up in
    every whole text. A passage is aligned when it has enough of an item's
    pairs to reach ``least_ratio`` or ``LONG_SCORE`` at all; no such passage
    is missed, however frequent its words. ``ratio`` is the alignment score
    over the item's score against itself.

    Items of fewer than ``LEAST_ITEM_WORDS`` words, and null items, are no
    evidence and never match; null and empty documents match nothing.
    Repeated items report once; repeated ids are one document. Items are
    handled in blocks of bounded size, one after the other, with two passes
    over the corpus per block (to count and to align), so a large benchmark
    needs no larger workers and no larger driver."""
    kind, item_kind = spark_type(docs, id_col), spark_type(items, item_id)
    tests = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where(
        "text is not null").distinct()
    size = tests.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = [materialize(_block_leaks(narrow, tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k),
                                      least_ratio, kind, item_kind)) for k in range(blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    best = every.groupBy("id", "item").agg(F.max(F.struct(
        "score", "ratio", "first_word", "last_word", "passage")).alias("best"))
    return best.select("id", "item", "best.*")


def seed_counts(narrow: DataFrame, index: Items) -> np.ndarray:
    """How often each seed of a block occurs in all texts; a task sums its
    own, and the driver gets one number a seed."""
    shared = narrow.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.seeds), np.int64)
        for batch in batches:
            for _, piece in chunks(batch.column(1)):
                total += np.bincount(_hits(block, piece)[3], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["seed", "n"])

    sums = narrow.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(index.seeds), np.int64)
    counts[sums.column("seed").to_numpy()] = sums.column("n").to_numpy()
    return counts


def _block_leaks(narrow: DataFrame, tests: DataFrame, least: float, kind: str, item_kind: str) -> DataFrame:
    index = Items.of(sorted(map(tuple, tests.collect()), key=str), least)
    if index_has(index):
        index = index.ranked(seed_counts(narrow, index))
    shared = narrow.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for at, piece in chunks(batch.column(1)) if index_has(block) else ():
                out, known = [], {}
                for d, i, first, words, text in passages(block, piece):
                    if (i, text) not in known:  # each distinct passage once
                        known[i, text] = align(block.words[i], words)
                    got, begin, end = known[i, text]
                    ratio = got / (MATCH * len(block.words[i]))
                    if ratio >= least or got >= LONG_SCORE:
                        out.append((at + d, block.ids[i], got, ratio, first + begin, first + end,
                                    text.decode("utf-8", "replace")))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1]),
                         pa.array(cols[2], pa.int64()), *[pa.array(c) for c in cols[3:]]],
                        names=["id", "item", "score", "ratio", "first_word", "last_word", "passage"])

    return narrow.mapInArrow(
        scan, f"id {kind}, item {item_kind}, score long, ratio double, first_word long, last_word long, passage string")


def index_has(index: Items) -> bool:
    return bool(index.ids)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options: object) -> DataFrame:
    """The rows of ``docs`` that hold no passage of an item; columns
    unchanged. Rows are told apart by id and text, so a repeated id with
    another text is judged by that text."""
    mine, said = unused_name(docs, "row_id"), unused_name(docs, "row_text")
    keyed = docs.withColumn(mine, row_key(docs, id_col, text_col)).withColumn(said, F.xxhash64(F.col(text_col)))
    row = F.struct(F.col(mine).alias("id"), F.col(said).alias("said"))
    bad = leaks(keyed.select(row.alias("doc"), F.col(text_col).alias("body")), items, "doc", "body", **options)
    bad = broadcast_if_small(bad.select(F.col("id.id").alias("leaked"), F.col("id.said").alias("leaked_text")).distinct())
    same = (F.col(mine) == F.col("leaked")) & (F.col(said) == F.col("leaked_text"))
    return keyed.join(bad, same, "left_anti").select(*[keyed[f"`{c}`"] for c in docs.columns])
