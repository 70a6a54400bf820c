"""Language-model scoring by prediction by partial matching over bytes: a
context trie with escape estimation (method D) and symbol exclusion.

A text is its sequence of tokens: words of lower-cased (A-Z) bytes, one space
between them, and one end symbol. Contexts are the last ``ORDER`` symbols; the
first words follow start symbols."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from sqlkiln.llm.common import chunks, spark_type
from sqlkiln.session import materialize, shared_dir

ORDER = 5
END, START, ALPHABET = 256, 257, 257  # bytes and the end can be predicted
BITS = 9
# Entries of the gram table that goes to every worker, at most (36 MB); and a
# token is shared that makes up one in so many of the training tokens, which
# bounds the number of shared tokens by the same figure.
MOST_SHARED, TOKEN_SHARE = 1_300_000, 4_000_000
PIECE_BYTES = 1024 * 1024
# Positions at a time (their arrays stay in the processor's cache), positions
# that are sorted together, and counted keys that a task holds: it sums them
# when there are so many, and gives them away if so many are left.
BLOCK, SORTED_AT_ONCE = 1 << 17, 1 << 21
MOST_COUNTED, SUM_AT = 1 << 20, 3 << 19
ROWS_A_BATCH = 1 << 16
SMOOTHING = 0.1
_BLANKS = re.compile(rb"[\x20\x09-\x0d]+")


def normal(data: bytes) -> bytes:
    """Words in lower case with single spaces; bytes methods know only ASCII
    letters and ASCII white space."""
    low = data.lower()
    return b" ".join(low.split()) if len(low) < PIECE_BYTES else _BLANKS.sub(b" ", low).strip()


class Trie:
    """The model as plain dictionaries, for adaptive scoring of one text (and
    as the reference of the tests). ``counts[context][symbol]`` for every
    context up to the order."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple, Counter] = defaultdict(Counter)

    def update(self, context: tuple, symbol: int) -> None:
        for k in range(self.order + 1):
            self.counts[context[self.order - k :]][symbol] += 1

    def log10(self, context: tuple, symbol: int) -> float:
        total, excluded = 0.0, frozenset()
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - k :])
            if not seen:
                continue
            fresh = {s: n for s, n in seen.items() if s not in excluded}
            if fresh:
                whole = sum(fresh.values())
                if symbol in fresh:
                    return total + math.log10((fresh[symbol] - 0.5) / whole)
                total += math.log10(0.5 * len(fresh) / whole)
            excluded = frozenset(seen)
        return total - math.log10(ALPHABET - len(excluded))

    def code(self, text: bytes, learn: bool) -> float:
        """log10 probability of a normal text; learning as it goes when
        ``learn``."""
        context, total = (START,) * self.order, 0.0
        for symbol in [*text, END]:
            total += self.log10(context, symbol)
            if learn:
                self.update(context, symbol)
            context = (*context, symbol)[1:] if self.order else ()
        return total


def adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``(id, score)``: the log10 probability of each text under a trie that
    starts empty and learns while it codes; nothing is shared between
    documents. Null is the empty text."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Trie(order).code(normal(t), True) for _, piece in chunks(batch.column(1)) for t in piece]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    return narrow.mapInArrow(run, f"id {spark_type(narrow, 'id')}, score double")


def grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each position, packed context and symbol of each position),
    in pieces of bounded size."""
    size = np.array([len(t) for t in texts], np.int64) + order + 1
    symbols = np.full(int(size.sum()), START, np.int16)
    at = 0
    for t in texts:
        symbols[at + order : at + order + len(t)] = np.frombuffer(t, np.uint8)
        symbols[at + order + len(t)] = END
        at += order + len(t) + 1
    stop = np.cumsum(size)
    for first in range(0, len(symbols) - order, BLOCK):
        part = symbols[first : first + BLOCK + order].astype(np.int64)
        n = len(part) - order
        packed = part[:n].copy()
        for k in range(1, order + 1):
            packed <<= BITS
            packed |= part[k : n + k]
        real = part[order:] != START
        low, high = first + order, first + order + n
        a, b = np.searchsorted(stop, (low, high - 1), "right")
        held = np.minimum(stop[a : b + 1], high) - np.maximum(stop[a : b + 1] - size[a : b + 1], low)
        yield np.repeat(np.arange(a, b + 1), held)[real], packed[real]


def token_keys(tokens: list[bytes]) -> np.ndarray:
    """Tokens are told apart by 64 bits (XXH64) as a signed number."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)).view(np.int64)


def token_places(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key of each distinct token, place there of every token, text of every
    token) of normal texts, in pieces of bounded size."""
    for part in [texts] if len(texts) > 1 else [[texts[0][a:b]] for a, b in _cuts(texts[0])]:
        split = pc.split_pattern(pa.array(part, pa.large_binary()), " ")
        found = split.flatten().dictionary_encode()
        place = found.indices.to_numpy()
        owner = np.repeat(np.arange(len(part)), pc.list_value_length(split).to_numpy())
        blank = (pc.binary_length(found.dictionary).to_numpy() == 0)[place]
        # No token holds a blank: one split makes all of them.
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary), pa.scalar(b" ", pa.large_binary()))
        yield token_keys(whole[0].as_py().split(b" ")), place[~blank], owner[~blank]


def _cuts(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of a normal text that end between words, of bounded size."""
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= PIECE_BYTES else text.find(b" ", at + PIECE_BYTES)
        to = len(text) if to < 0 else to
        yield at, to
        at = to


@dataclass
class Shared:
    """An exact map from 64-bit keys to numbers as an open-addressing table,
    looked up a whole array at a time; ``empty``, which is no key, marks free
    slots."""

    keys: np.ndarray
    values: np.ndarray
    empty: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Shared:
        size = 1 << max(4, int(1.5 * len(keys)).bit_length())
        empty = -1
        while (keys == empty).any():
            empty -= 1
        table = Shared(np.full(size, empty, np.int64), np.zeros(size), empty)
        left, slot = np.arange(len(keys)), table._slot(keys)
        while len(left):
            open_ = table.keys[slot] == empty
            free = left[open_]
            where, first = np.unique(slot[open_], return_index=True)
            winner = free[first]
            table.keys[where], table.values[where] = keys[winner], values[winner]
            lost = ~np.isin(left, winner)
            left, slot = left[lost], (slot[lost] + 1) & (size - 1)
        return table

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of every key."""
        slot = self._slot(keys)
        there = self.keys.take(slot)
        hit, value = there == keys, self.values.take(slot)
        left = np.flatnonzero(~hit & (there != self.empty))
        slot, asked = slot[left], keys[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys.take(slot)
            same = there == asked
            hit[left[same]], value[left[same]] = True, self.values.take(slot[same])
            more = ~same & (there != self.empty)
            left, slot, asked = left[more], slot[more], asked[more]
        hit &= keys != self.empty
        value[~hit] = 0.0
        return hit, value


class Tally:
    """Occurrences of keys in training texts and in all, summed within a task
    as long as it holds at most ``MOST_COUNTED`` keys."""

    def __init__(self, kind: str):
        self.kind, self.parts, self.held = kind, [], 0

    def put(self, key: np.ndarray, n: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((key, n, seen))
        self.held += len(key)
        if self.held > SUM_AT:
            self._sum()
            if self.held > MOST_COUNTED:
                yield from self.rest()

    def _sum(self) -> None:
        key, n, seen = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key, n, seen = key[order], n[order], seen[order]
        first = _firsts(key)
        self.parts = [(key[first], np.add.reduceat(n, first), np.add.reduceat(seen, first))]
        self.held = len(first)

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is held, which is given away."""
        if self.held:
            self._sum()
            (key, n, seen), = self.parts
            self.parts, self.held = [], 0
            for at in range(0, len(key), ROWS_A_BATCH):
                to = at + ROWS_A_BATCH
                yield _counted(key[at:to], n[at:to], seen[at:to], self.kind)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


class GramTally(Tally):
    """A tally that is given the gram of every position."""

    def __init__(self):
        super().__init__("gram")
        self.raw, self.waiting = [], 0

    def add(self, packed: np.ndarray, learned: bool) -> Iterator[pa.RecordBatch]:
        # The lowest bit tells whether the position is learned.
        self.raw.append((packed.view(np.uint64) << np.uint64(1)) | np.uint64(learned))
        self.waiting += len(packed)
        if self.waiting >= SORTED_AT_ONCE:
            yield from self._count()

    def _count(self) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(self.raw)
        self.raw, self.waiting = [], 0
        every.sort()
        gram = (every >> np.uint64(1)).view(np.int64)
        first = _firsts(gram)
        n = np.add.reduceat((every & np.uint64(1)).view(np.int64), first)
        yield from self.put(gram[first], n, np.diff(first, append=len(every)))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            yield from self._count()
        yield from super().rest()


def gathered(docs: DataFrame, training: Column, id_col: str, text_col: str, order: int) -> DataFrame:
    """``(gram, token, n, seen)``: one row per distinct gram (token null) or
    token key (gram null): occurrences in training texts, and in all. Summed
    within a task and then by key; it covers every text."""
    narrow = docs.select(training.alias("training"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_gram, by_token = GramTally(), Tally("token")
        for batch in batches:
            learn = batch.column(0).to_pylist()
            for at, piece in chunks(batch.column(1), PIECE_BYTES):
                for wanted in (True, False):
                    texts = [normal(t) for i, t in enumerate(piece, at) if bool(learn[i]) is wanted]
                    for _, packed in grams(texts, order) if texts else ():
                        yield from by_gram.add(packed, wanted)
                    for keys, place, _ in token_places(texts) if wanted and texts else ():
                        n = np.bincount(place, minlength=len(keys))
                        yield from by_token.put(keys[n > 0], n[n > 0], n[n > 0])
        yield from by_gram.rest()
        yield from by_token.rest()

    rows = narrow.mapInArrow(count, "gram long, token long, n long, seen long")
    return rows.groupBy("gram", "token").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _counted(key: np.ndarray, n: np.ndarray, seen: np.ndarray, kind: str) -> pa.RecordBatch:
    keys, none = pa.array(key, pa.int64()), pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays(
        [keys if kind == "gram" else none, keys if kind == "token" else none, pa.array(n, pa.int64()),
         pa.array(seen, pa.int64())], names=["gram", "token", "n", "seen"])


def _suffix(gram: Column, order: int) -> Column:
    """Context of ``order`` symbols and the symbol, of a longer gram."""
    return gram.bitwiseAND(F.lit((1 << (BITS * (order + 1))) - 1).cast("long"))


def _context(gram: Column) -> Column:
    return F.shiftright(gram, BITS)


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """``(gram, seen, p)`` for every gram of any text: its log10 probability.

    Grams of the training texts are predicted by their full context. Unseen
    ones escape from context to shorter context, each time leaving out the
    symbols of the longer one: with T the occurrences and D the distinct
    symbols of a context, and O the occurrences there of the symbols of the
    longer context (D' of them), a symbol seen n times has (n - 1/2) / (T - O)
    and the escape (D - D') / 2 over the same. What no context knows is uniform
    over the symbols left. Every level is one aggregate of the level above;
    contexts of up to one symbol are broadcast, their number is fixed by the
    alphabet."""
    known = counts.where("n > 0").select("gram", "n")
    level = {order: known}
    for k in range(order - 1, -1, -1):
        up = level[k + 1]
        level[k] = materialize(up.groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.sum("n").alias("n")))
    stats = {}
    for k in range(order, -1, -1):
        own = level[k].select("gram", F.col("n").alias("here"))
        if k:
            below = level[k - 1].select(F.col("gram").alias("short"), F.col("n").alias("there"))
            own = own.withColumn("short", _suffix(F.col("gram"), k - 1))
            own = own.join(F.broadcast(below) if k <= 2 else below, "short")
        else:
            own = own.withColumn("there", F.lit(0))
        stats[k] = materialize(own.groupBy(_context(F.col("gram")).alias("context")).agg(
            F.sum("here").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("there").alias("o")))
    seen = known.join(counts.select(F.col("gram").alias("g"), "seen"), F.col("gram") == F.col("g"))
    seen = seen.withColumn("at", _context(F.col("gram"))).join(stats[order], F.col("at") == F.col("context"))
    seen = seen.select("gram", "seen", F.log10((F.col("n") - 0.5) / F.col("t")).alias("p"))
    new = counts.where("gram is not null and n = 0").select(
        "gram", "seen", F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("up_o"), F.lit(0).cast("long").alias("up_d"),
        F.lit(False).alias("done"))
    for k in range(order, -1, -1):
        new = new.withColumn("short", _suffix(F.col("gram"), k)).withColumn("at", _context(F.col("short")))
        here = stats[k]
        new = new.join(F.broadcast(here) if k <= 1 else here, F.col("at") == F.col("context"), "left")
        counted = level[k].select(F.col("gram").alias("known"), "n")
        new = new.join(F.broadcast(counted) if k <= 1 else counted, F.col("short") == F.col("known"), "left")
        whole = F.col("t") - F.col("up_o")
        fresh = (F.col("d") - F.col("up_d")) / 2
        open_ = ~F.col("done") & F.col("t").isNotNull()
        step = F.when(~open_, 0.0).when(F.col("n").isNotNull(), F.log10((F.col("n") - 0.5) / whole)).when(
            fresh > 0, F.log10(fresh / whole)).otherwise(0.0)
        new = materialize(new.select(
            "gram", "seen", (F.col("p") + step).alias("p"), F.when(open_, F.col("o")).otherwise(F.col("up_o")).alias("up_o"),
            F.when(open_, F.col("d")).otherwise(F.col("up_d")).alias("up_d"),
            (F.col("done") | (open_ & F.col("n").isNotNull())).alias("done")))
    rest = F.when(F.col("done"), 0.0).otherwise(-F.log10((ALPHABET - F.col("up_d")).cast("double")))
    return seen.unionAll(new.select("gram", "seen", (F.col("p") + rest).alias("p")))


def most_frequent(table: DataFrame, weight: str, most: int) -> DataFrame:
    """The rows of the largest ``weight``, at most ``most`` of them by count:
    those from the lowest power-of-two step up that stays within it."""
    steps = table.groupBy(F.floor(4 * F.log2(F.col(weight).cast("double"))).alias("step")).count()
    held, least = 0, None
    for r in sorted(steps.where("step is not null").collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return table.where("false")
    return table.where(F.floor(4 * F.log2(F.col(weight).cast("double"))) >= least)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
          most_shared: int = MOST_SHARED, token_share: int = TOKEN_SHARE) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    ``score`` is the log10 probability of the whole text under the trie of
    the texts that ``training`` picks; ``base_score`` that of its tokens
    under add-0.1 smoothed token counts of the same texts. The most frequent
    grams (at most ``most_shared``) and every token that makes up one in
    ``token_share`` training tokens go to the workers; all others are joined
    by key, where none is frequent enough to crowd a task. Nothing is pruned. Null and empty texts have the end token alone. Rows are kept one
    for one, repeated and null ids included. Without training texts every
    symbol is uniform."""
    spark = docs.sparkSession
    kind = spark_type(docs, id_col)
    counts = materialize(gathered(docs, training, id_col, text_col, order))
    tokens = counts.where("gram is null and token is not null").select("token", "n")
    row = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    ends = counts.where((F.col("gram").bitwiseAND((1 << BITS) - 1) == END)).agg(F.sum("n")).collect()[0][0] or 0
    total = (row["n"] or 0) + ends
    types = row["v"] + (ends > 0)
    bottom = math.log10(total + SMOOTHING * (types + 1))
    scored = materialize(gram_scores(counts, order))
    often = tokens.where(F.col("n") * F.lit(token_share) >= F.lit(total))
    shared = [spark.sparkContext.broadcast(_shared(*x)) for x in (
        (most_frequent(scored, "seen", most_shared), "gram", "p"), (often, "token", "n"))]
    end_value = math.log10(ends + SMOOTHING)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_table, token_table = shared[0].value, shared[1].value
        row_id = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at, piece in chunks(batch.column(1), PIECE_BYTES):
                texts = [normal(t) for t in piece]
                size = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
                base, known = np.full(len(texts), end_value), np.full(len(texts), int(ends > 0), np.int64)
                model = np.zeros(len(texts))
                rare = []
                for owner, packed in grams(texts, order):
                    hit, p = gram_table.find(packed)
                    model += np.bincount(owner, p, len(texts))
                    rare.append((owner[~hit], packed[~hit], "gram"))
                for keys, place, owner in token_places(texts):
                    hit, n = token_table.find(keys)
                    value = np.where(hit, np.log10(n + SMOOTHING), 0.0)[place]
                    hit = hit[place]
                    base += np.bincount(owner, value, len(texts))
                    known += np.bincount(owner[hit], minlength=len(texts))
                    rare.append((owner[~hit], keys[place[~hit]], "token"))
                ids = row_id + np.arange(len(texts))
                row_id += len(texts)
                yield _scored(ids, batch.column(0).slice(at, len(texts)), size + 1, known, base, model)
                for what in ("gram", "token"):
                    found = [(owner, keys) for owner, keys, kept in rare if kept == what and len(keys)]
                    if found:
                        owner, keys = (np.concatenate(c) for c in zip(*found))
                        yield _rare(ids[owner], keys, what, batch.column(0).type)

    schema = (f"row long, id {kind}, size long, known long, base double, model double, gram long, token long, n long")
    # A written table: mostly nulls and repeated values, which Parquet packs.
    path = shared_dir(spark, "ppm")
    narrow.mapInArrow(run, schema).write.parquet(path)
    out = spark.read.parquet(path)
    whole = out.where("size is not null").select("row", "id", "size", "known", "base", "model")
    left = out.where("gram is not null").select("row", F.col("gram").alias("key"), F.col("n").alias("times"))
    by_gram = left.join(scored.select("gram", "p"), F.col("key") == F.col("gram")).select(
        "row", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("size"),
        F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("p") * F.col("times")).alias("model"))
    left = out.where("token is not null").select("row", F.col("token").alias("key"), F.col("n").alias("times"))
    found = F.coalesce(F.col("n"), F.lit(0))
    by_token = left.join(tokens, F.col("key") == F.col("token"), "left").select(
        "row", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("size"),
        F.when(found > 0, F.col("times")).otherwise(0).alias("known"),
        (F.log10(found + SMOOTHING) * F.col("times")).alias("base"), F.lit(0.0).alias("model"))
    every = whole.unionAll(by_gram).unionAll(by_token).groupBy("row").agg(
        F.max("id").alias("id"), F.max("size").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base"), F.sum("model").alias("score"))
    return every.select("id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
                        (F.col("base") - F.col("n_tokens") * bottom).alias("base_score"), "score")


def _shared(table: DataFrame, key: str, value: str) -> Shared:
    rows = table.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).toArrow()
    return Shared.of(rows.column("k").to_numpy().astype(np.int64), rows.column("v").to_numpy().astype(np.float64))


def _scored(ids: np.ndarray, doc_ids: pa.Array, size: np.ndarray, known: np.ndarray, base: np.ndarray,
            model: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), doc_ids, pa.array(size), pa.array(known), pa.array(base), pa.array(model), none, none, none],
        names=["row", "id", "size", "known", "base", "model", "gram", "token", "n"])


def _rare(rows: np.ndarray, keys: np.ndarray, what: str, id_type: pa.DataType) -> pa.RecordBatch:
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.union1d(_firsts(rows), _firsts(keys))
    n = np.diff(first, append=len(rows))
    none, number = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.float64())
    key = pa.array(keys[first])
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[first]), pa.nulls(len(n), id_type), none, none, number, number,
         key if what == "gram" else none, key if what == "token" else none, pa.array(n, pa.int64())],
        names=["row", "id", "size", "known", "base", "model", "gram", "token", "n"])
