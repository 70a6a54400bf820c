"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from sqlkiln.llm.common import row_key, spark_type, unused_name
from sqlkiln.llm.components import components
from sqlkiln.session import materialize

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BITS = 64
# Hashes whose bits are unpacked at once (64 bytes each).
BLOCK = 1 << 17


def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text, as an unsigned 64-bit number."""
    found = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle_words, len(found))
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, np.int64), len(found) - width + 1
    for at in range(0, total, BLOCK):
        to = min(total, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash of each whole text as a signed long.

    Word shingles (repeats included) hash with XXH64 seed 42 over their
    lower-cased (A-Z) UTF-8 bytes; a bit is set when over half the hashes
    have it. Fewer words than a shingle: the whole sequence is the one
    shingle. Null, empty or blank text: fingerprint 0. A null id is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.array([simhash(t.as_py() or b"", shingle_words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {spark_type(narrow, 'id')}, fp long")


def ball_masks(radius: int) -> list[int]:
    """XOR masks of every variant within ``radius`` bits, nearest first, as
    signed longs."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in itertools.combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links ``(a, b)`` between distinct fingerprints (column
    ``fp``) that join exactly the pairs within ``radius`` bits into
    components.

    Each fingerprint emits its variants within half the radius (rounded up),
    and two fingerprints within ``radius`` share a variant that is within
    half the radius, rounded down, of one of them. All members of a variant
    are therefore within ``radius`` of its smallest such near member, so a
    link from each member to that one keeps every component; no pairs within
    a variant are emitted. A variant holds at most as many distinct
    fingerprints as the ball has points (65 for radius 2), so no group grows
    with the data."""
    masks, near = ball_masks((radius + 1) // 2), len(ball_masks(radius // 2))
    emitted = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("nth", "mask"))
    emitted = emitted.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"),
                             F.when(F.col("nth") < near, F.col("fp")).alias("near"))
    met = emitted.withColumn("anchor", F.min("near").over(Window.partitionBy("variant")))
    met = met.where("anchor is not null and anchor <> fp").select(F.col("fp").alias("a"), F.col("anchor").alias("b"))
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``(id, fp, component)``, where ``component`` is
    the smallest id reachable over links of at most ``radius`` bits.

    Copies share a fingerprint and are folded into it before the ball is
    emitted, so a group of copies of any size costs one fingerprint. Rows
    with a null id get the component of their fingerprint; it is null only
    when the whole component has no id. Repeated ids stay repeated rows. An
    empty table gives no rows. Other columns of ``docs`` are ignored."""
    each = materialize(fingerprints(docs, id_col, text_col, shingle_words))
    fps = materialize(each.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps.select("fp"), radius))
    linked = materialize(fps.join(roots, F.col("fp") == F.col("node")).select("fp", "least", "root"))
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component")))
    linked = linked.join(least, "root").select(F.col("fp").alias("linked"), "component")
    of = fps.join(linked, F.col("fp") == F.col("linked"), "left")
    of = materialize(of.select(F.col("fp").alias("of"), F.coalesce("component", "least").alias("component")))
    return each.join(of, F.col("fp") == F.col("of"), "left").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group:
    the one with the smallest id, and one row only if that id repeats. Rows
    are told apart by id and text, so a repeated id with other texts stands in
    each group of its texts. A row with a null id stands after all rows with
    ids. Columns are unchanged, whatever they are called."""
    mine, said = unused_name(docs, "row_id"), unused_name(docs, "row_text")
    keyed = docs.withColumn(mine, row_key(docs, id_col, text_col)).withColumn(said, F.xxhash64(F.col(text_col)))
    row = F.struct(F.col(mine).alias("id"), F.col(said).alias("said"))
    groups = near_duplicates(keyed.select(row.alias("doc"), F.col(text_col).alias("body")), "doc", "body",
                             shingle_words, radius)
    stay = groups.where("id = component").select(F.col("id.id").alias("stay"), F.col("id.said").alias("stay_text")).distinct()
    same = (F.col(mine) == F.col("stay")) & (F.col(said) == F.col("stay_text"))
    kept = keyed.join(materialize(stay), same, "left_semi")
    first = unused_name(docs, "nth_row")
    kept = kept.withColumn(first, F.row_number().over(Window.partitionBy(mine, said).orderBy(mine)))
    return kept.where(F.col(first) == 1).select(*[kept[f"`{c}`"] for c in docs.columns])
