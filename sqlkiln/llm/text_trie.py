"""Compressed tries over whole texts, and text ranges by adaptive prefixes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from sqlkiln.llm.running import running
from sqlkiln.session import broadcast_if_small, materialize

# Prefixes are lengthened by this factor until none is too heavy.
FIRST_PREFIX, LONGER = 8, 4
# The most text bytes that one range is to hold.
RANGE_BYTES = 128 * 1024 * 1024
# Ranges a shuffle partition, so that ranges of uneven weight even out.
RANGES_A_PARTITION = 4


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    """A trie node: the bytes on the edge to it, its children by first byte,
    and the least id of the texts that end here (None: none does)."""

    __slots__ = ("label", "kids", "least")

    def __init__(self, label: bytes):
        self.label, self.kids, self.least = label, {}, None


class Trie:
    """A radix tree of texts; ``held`` counts the bytes on its edges."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, text: bytes, doc_id: Any) -> Node:
        """The terminal of a text, holding the least id seen for it (a null
        id leaves it as it is)."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.held += len(kid.label)
                node, at = kid, len(text)
            elif text.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
            else:
                cut = common_prefix(kid.label, text[at : at + len(kid.label)])
                middle = node.kids[text[at]] = Node(kid.label[:cut])
                kid.label = kid.label[cut:]
                middle.kids[kid.label[0]] = kid
                node, at = middle, at + cut
        if doc_id is not None and (node.least is None or doc_id < node.least):
            node.least = doc_id
        return node


def range_bounds(texts: DataFrame, body: str, most: int = RANGE_BYTES) -> list[bytes]:
    """Sorted prefixes; range k holds the texts from bound k - 1 up to, not
    including, bound k, so equal texts share a range.

    Texts are weighed by their first 8 bytes; only the prefixes that are too
    heavy are told apart by 32, 128, ... bytes, until each is light or is one
    text. Light prefixes are then joined in order up to the weight of a range:
    the total over 4 ranges a shuffle partition, and at most ``most``. Nothing
    is sampled; the driver gets the bounds alone, one for each range. A bound
    is as short as the round that told its texts apart."""
    spark = texts.sparkSession
    size = F.octet_length(body) + 1
    mark = F.xxhash64(body)
    weighed, length, heavy, limit = None, FIRST_PREFIX, None, None
    while True:
        rows = texts
        if heavy is not None:
            rows = texts.join(broadcast_if_small(heavy.select("prefix")), F.substring(body, 1, length // LONGER) == F.col("prefix"), "left_semi")
        cells = materialize(rows.groupBy(F.substring(body, 1, length).alias("prefix")).agg(
            F.sum(size.cast("long")).alias("bytes"), (F.min(mark) < F.max(mark)).alias("several")))
        if limit is None:
            total = cells.agg(F.sum("bytes")).first()[0] or 0
            partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
            limit = max(1, min(most, total // (RANGES_A_PARTITION * partitions)))
        heavy = cells.where((F.col("bytes") > limit) & F.col("several"))
        light = cells.where((F.col("bytes") <= limit) | ~F.col("several")).select("prefix", "bytes")
        weighed = light if weighed is None else weighed.unionByName(light)
        if heavy.isEmpty():
            break
        length *= LONGER
    placed = running(weighed, [], ["prefix"], "bytes")
    firsts = placed.groupBy(F.floor(F.col("before") / limit)).agg(F.min("prefix").alias("bound"))
    return sorted(bytes(r["bound"]) for r in firsts.select("bound").collect())[1:]
