"""Audit of how document filters interact, with duplicates found by radix
text tries."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sqlkiln.llm.common import ASCII_UPPER, chunks, words
from sqlkiln.llm.text_trie import Trie, range_bounds

# Text that one local trie holds before its rows are handed on.
LOCAL_BYTES = 16 * 1024 * 1024
DUPLICATE = "E"


def quality_filters(text: Column) -> dict[str, Column]:
    """The failure conditions of the registered audit, by letter: under 50
    words; under 65 % distinct words; over 5 % of characters in A-Z; any of
    ``#$%&*|``."""
    said = F.coalesce(text, F.lit(""))
    found = words(said)
    capitals = F.length(said) - F.length(F.translate(said, ASCII_UPPER, ""))
    return {
        "A": F.size(found) < 50,
        "B": 100 * F.size(F.array_distinct(found)) < 65 * F.size(found),
        "C": 100 * capitals > 5 * F.length(said),
        "D": said.rlike(r"[#$%&*|]"),
    }


def _counted(found: Counter, schema: pa.Schema) -> pa.RecordBatch:
    rows = [(*key, n) for key, n in found.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _local(bounds: list[bytes], dup_bit: int, schema: pa.Schema):
    """Rows of a task in tries of bounded size. A row with a smaller id for
    its text in the same trie is a duplicate for good; a row without an id is
    none. Only the row that holds the least id (and its exact repeats, as a
    count) goes on with its text, so a text of any number of copies reaches
    its range once a local trie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        salt = -1 - (task.partitionId() if task else 0)
        trie, held = Trie(), []

        def decided() -> Iterator[pa.RecordBatch]:
            sure, open_, size = Counter(), Counter(), 0
            text = {}
            for body, node, doc_id, part, mask in held:
                if doc_id is None or node.least < doc_id:
                    sure[salt, doc_id, part, mask | (dup_bit if doc_id is not None else 0), None] += 1
                else:
                    open_[id(node), doc_id, part, mask] += 1
                    text[id(node)] = body
            if sure:
                yield _counted(sure, schema)
            out = Counter()
            for (node, doc_id, part, mask), n in open_.items():
                body = text[node]
                out[bisect_right(bounds, body), doc_id, part, mask, body] += n
                size += len(body)
                if size > LOCAL_BYTES // 4:
                    yield _counted(out, schema)
                    out, size = Counter(), 0
            if out:
                yield _counted(out, schema)

        size = 0
        for batch in batches:
            ids, parts, masks = (batch.column(i) for i in range(3))
            for at, bodies in chunks(batch.column(3)):
                span = slice(at, at + len(bodies))
                for body, doc_id, part, mask in zip(bodies, ids[span].to_pylist(), parts[span].to_pylist(), masks[span].to_pylist()):
                    held.append((body, trie.insert(body, doc_id), doc_id, part, mask))
                    size += len(body)
                if size > LOCAL_BYTES:
                    yield from decided()
                    trie, held, size = Trie(), [], 0
        if held:
            yield from decided()
    return run


def _ranged(dup_bit: int, schema: pa.Schema):
    """Rows of whole ranges in the order of range and id: one trie a range,
    so that the first row of a text has its least id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at_range = Trie(), None
        for batch in batches:
            found = Counter()
            columns = [batch.column(i) for i in range(4)]
            has = batch.column(4).is_valid().to_pylist()
            counts = batch.column(5)
            for at, bodies in chunks(batch.column(4)):
                span = slice(at, at + len(bodies))
                for body, text, rng, doc_id, part, mask, n in zip(bodies, has[span], *(c[span].to_pylist() for c in columns), counts[span].to_pylist()):
                    if text:
                        if rng != at_range:
                            trie, at_range = Trie(), rng
                        if trie.insert(body, doc_id).least < doc_id:
                            mask |= dup_bit
                    found[doc_id, part, mask] += n
            if found:
                yield _counted(found, schema)
    return run


def failures(docs: DataFrame, filters: dict[str, Column], duplicate: str = DUPLICATE, id_col: str = "doc_id",
             text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, mask, n)``: how many rows have this id and part and fail
    exactly the filters in ``mask`` (bit k: the k-th letter in order).

    ``filters`` are native conditions on columns of ``docs`` (a null condition
    passes); ``duplicate`` is the filter that a row fails if any row of the
    table with a smaller id has the same text, whatever became of it. Null
    text is the empty text, a null part the empty part; a null id is neither
    smaller nor larger than any; rows repeated with their id are no duplicates
    of each other. An empty table gives no rows. Texts are compared whole, by
    bytes: they are inserted into a local trie of each task, and what is left
    open goes to the trie of its range of prefixes. A text moves once."""
    letters = sorted([*filters, duplicate])
    bits = {c: 1 << k for k, c in enumerate(letters)}
    mask = sum((F.when(cond, bits[c]).otherwise(0) for c, cond in filters.items()), F.lit(0))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         mask.cast("int").alias("mask"), body.alias("body"))
    bounds = range_bounds(narrow.select("body"), "body")
    wide = docs.sparkSession.createDataFrame([], "rng int, id string, part string, mask int, body binary, n long").withColumn(
        "id", F.lit(None).cast(narrow.schema["id"].dataType))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema)
    open_ = narrow.mapInArrow(_local(bounds, bits[duplicate], to_arrow_schema(wide.schema)), kinds)
    dealt = open_.repartition("rng").sortWithinPartitions("rng", "id")
    slim = wide.select("id", "part", "mask", "n")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return dealt.mapInArrow(_ranged(bits[duplicate], to_arrow_schema(slim.schema)), kinds)


def reduce_masks(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, masks)``: for each part the rows per mask, at most one entry
    a mask: ``n``, and of these ``good`` (labels: quality 1) and ``toxic``. A
    label counts once however often it is repeated; of conflicting labels a 1
    counts. A row without a label is neither."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    met = failed.join(marks, failed["id"] == marks["of"], "left")
    sums = met.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, with the counts that
    the order gives: ``kept``, ``removed``, ``redundant`` (fails this filter
    but was removed before), ``unique_fails`` (fails this filter alone),
    ``good_lost``, ``toxic_lost`` and ``shapley`` (rows the filter removes,
    summed over all orders). A part with nothing to remove has zeros; no part,
    no rows. Local to a part; the orders are a fixed list."""
    orders = ["".join(p) for p in itertools.permutations(letters)]
    names = F.split(F.lit(",".join(orders)), ",")
    each = masks.withColumn("filter_order", F.explode(names)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))

    def bits(text: Column) -> Column:
        marks = [F.when(F.contains(text, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(sorted(letters))]
        return sum(marks[1:], marks[0])

    each = each.withColumn("bit", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn(
        "before", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))

    def total(what, keep) -> Column:
        kept = F.filter("masks", keep)
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, e: a + what(e)).cast("long")

    bit, before = F.col("bit"), F.col("before")
    fails = lambda e: e["mask"].bitwiseAND(bit) != 0
    here = lambda e: fails(e) & (e["mask"].bitwiseAND(before) == 0)
    n = lambda e: e["n"]
    fact = len(orders)
    return each.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(n, lambda e: e["mask"].bitwiseAND(before + bit) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda e: fails(e) & (e["mask"].bitwiseAND(before) != 0)).alias("redundant"),
        total(n, lambda e: e["mask"] == bit).alias("unique_fails"),
        total(lambda e: e["good"], here).alias("good_lost"),
        total(lambda e: e["toxic"], here).alias("toxic_lost"),
        # A row is removed by each of its failing filters equally often.
        total(lambda e: F.floor(F.lit(fact) / F.bit_count(e["mask"])) * e["n"], fails).alias("shapley"))
