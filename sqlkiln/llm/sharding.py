"""Sharding over fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from sqlkiln.llm.running import running
from sqlkiln.session import materialize

SLOTS = 4096
SHARDS = 16


def slot_of(record_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: a hash of its id and its text, fixed for
    all time, so that records without an id, or with the same one, spread
    over the slots by their texts."""
    known = F.coalesce(record_id.cast("string"), F.lit(""))
    return F.pmod(F.xxhash64(known, F.coalesce(text.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one, so that every record
    weighs something."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_weights(records: DataFrame, slot_col: str = "vslot", size_col: str = "size") -> DataFrame:
    """``(vslot, bytes, records)``: one row per slot in use, summed with
    map-side combine."""
    return records.groupBy(F.col(slot_col).alias("vslot")).agg(
        F.sum(size_col).alias("bytes"), F.count(F.lit(1)).alias("records"))


def balance(weights: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first map: heaviest slot first, each to the lightest shard. Slots
    not in use are dealt round, so that later records find a home. At most
    ``slots`` entries are handled, whatever the number of records."""
    heap = [(0, s) for s in range(shards)]
    owner: dict[int, int] = {}
    for slot in sorted(weights, key=lambda v: (-weights[v], v)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return {v: owner.get(v, v % shards) for v in range(slots)}


def rebalance(owner: dict[int, int], weights: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The next version of a map: the least editing that evens the shards.
    Slots of shards that no longer exist go first, then the largest slot that
    still helps moves from the heaviest to the lightest shard, until the
    spread is within ``tolerance`` of the mean or no move narrows it. All
    other slots stay where they are; ``shards`` may be more or fewer."""
    new = dict(owner)
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    homeless = []
    for slot in sorted(new):
        if new[slot] in load:
            load[new[slot]] += weights.get(slot, 0)
            held[new[slot]].append((weights.get(slot, 0), slot))
        else:
            homeless.append((weights.get(slot, 0), slot))
    for w, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        to = min(load, key=lambda s: (load[s], s))
        new[slot], load[to] = to, load[to] + w
        held[to].append((w, slot))
    mean = sum(load.values()) / shards
    for _ in range(4 * len(new)):
        high = max(load, key=lambda s: (load[s], -s))
        low = min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [(w, slot) for w, slot in held[high] if 0 < w < gap]
        if gap <= tolerance * mean or not fits:
            break
        w, slot = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove((w, slot))
        held[low].append((w, slot))
        new[slot], load[high], load[low] = low, load[high] - w, load[low] + w
    return new


def map_table(spark: SparkSession, owner: dict[int, int], version: int) -> DataFrame:
    """``(version, vslot, shard)``: one version of the map as a table."""
    rows = [Row(version=version, vslot=v, shard=s) for v, s in sorted(owner.items())]
    return spark.createDataFrame(rows, "version int, vslot int, shard int")


def store_map(owner: dict[int, int], version: int, path: str, spark: SparkSession) -> None:
    """Add a version to the stored map (one folder per version; an existing
    version is never overwritten)."""
    map_table(spark, owner, version).write.mode("error").parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    rows = spark.read.parquet(f"{path}/version={version:06d}").collect()
    return {r["vslot"]: r["shard"] for r in rows}


def shard_column(vslot: Column, owner: dict[int, int]) -> Column:
    """The shard of a slot as an array lookup (the map has a fixed number of
    entries), so records never move to learn their shard."""
    return _lookup([owner[v] for v in range(len(owner))], "int", vslot)


def _lookup(values: list[int], kind: str, at: Column) -> Column:
    return F.element_at(F.expr(f"cast(array({','.join(map(str, values))}) as array<{kind}>)"), at + 1)


def plan(records: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> dict[int, int]:
    """Version 0 of the map for records ``(vslot, size)``; only the per-slot
    sums, at most ``slots`` rows, reach the driver."""
    weights = {r["vslot"]: r["bytes"] for r in slot_weights(records).collect()}
    return balance(weights, shards, slots)


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id",
            text_col: str = "text", slot_name: str = "vslot", shard_name: str = "shard") -> DataFrame:
    """``docs`` with its virtual slot and shard; only the slot sums shuffle.
    A column of ``docs`` with one of those names is replaced."""
    slot = slot_of(F.col(id_col), F.col(text_col), slots)
    owner = plan(docs.select(slot.alias("vslot"), record_size(F.col(text_col)).alias("size")), shards, slots)
    return docs.withColumns({slot_name: slot, shard_name: shard_column(slot, owner)})


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, vslot, shard, slot)`` per record.

    Shard sizes in bytes come out as equal as whole slots allow. ``slot`` is
    the record's place in its shard, 0, 1, 2, ... without gaps: records are
    numbered inside each virtual slot (ordered by id, then text checksum) and
    start where the shard's earlier virtual slots end. Neither a shard nor a
    slot is gathered into one task, however often a record is repeated. Null
    text: size 1, checksum 0. Repeated rows are records of their own, in the
    slot of the first; a null id hashes like an empty one. An empty table
    gives no rows. Texts never shuffle."""
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), record_size(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col(id_col), F.col(text_col), slots).alias("vslot")))
    sums = {r["vslot"]: (r["bytes"], r["records"]) for r in slot_weights(rows).collect()}
    owner = balance({v: b for v, (b, _) in sums.items()}, shards, slots)
    begin = _offsets(owner, ((v, n) for v, (_, n) in sums.items()))
    ahead = _lookup(begin, "bigint", F.col("vslot"))
    placed = running(rows.withColumn("nth", F.monotonically_increasing_id()), ["vslot"], ["id", "text_crc32", "size", "nth"])
    return placed.select("id", "size", "text_crc32", "vslot", shard_column(F.col("vslot"), owner).alias("shard"),
                         (F.col("before") + ahead).alias("slot"))


def _offsets(owner: dict[int, int], counts: Iterable[tuple[int, int]]) -> list[int]:
    count, at, begin = dict(counts), {}, []
    for v in range(len(owner)):
        begin.append(at.get(owner[v], 0))
        at[owner[v]] = begin[-1] + count.get(v, 0)
    return begin


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id",
                 text_col: str = "text") -> dict[int, int]:
    """The sharded data set: ``path/data`` partitioned by shard, and version
    0 of the map under ``path/map``. Files of a shard are written by as many
    tasks as read them, so no shard goes through one task."""
    weighed = docs.select(slot_of(F.col(id_col), F.col(text_col), slots).alias("vslot"), record_size(F.col(text_col)).alias("size"))
    owner = plan(weighed, shards, slots)
    store_map(owner, 0, f"{path}/map", docs.sparkSession)
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    docs.withColumn(name, shard_column(slot_of(F.col(id_col), F.col(text_col), slots), owner)).write.partitionBy(name).parquet(f"{path}/data")
    return owner
