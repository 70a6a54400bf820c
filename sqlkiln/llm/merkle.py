"""Merkle manifest of a table by time-forward processing.

The records of a group are the leaves of a tree; every run of consecutive
nodes has one parent, and the groups' roots are the leaves of a top tree. A
node's label is (last leaf below it, height): every child has a smaller label
than its parent, so a sweep over the labels in order may send each digest
forward in time, to a priority queue that hands it out when the parent's label
is reached. The reversed sweep sends to each child the proof suffix of its
parent, until the leaves hold whole proofs.

A sweep is cut into epochs of ``EPOCH`` heights and blocks of consecutive
leaves. Inside a block the queue is a heap of at most ``fanout`` messages per
height; between epochs it is a written table that Spark's sort brings into
label order, spilling as it must. So a group of any size is many blocks, and
the second epoch has ``fanout ** EPOCH`` times fewer rows."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sqlkiln.llm.common import spark_type
from sqlkiln.llm.running import running
from sqlkiln.session import materialize

FANOUT = 16
EPOCH = 3
# Rows that a sweep reads or hands out at once.
OUT_ROWS = 1024
PROOF = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` if null, else its UTF-8 byte count,
    a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of a record's encoded fields."""
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all sibling digests of a proof, leaf to root, left to
    right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclass
class Block:
    """One block of a sweep: leaves ``first``, ``first + 1``, ... of a group
    that has ``size`` nodes at this height, up to ``top`` heights above."""

    first: int
    size: int
    top: int
    fanout: int
    queue: list[tuple[int, int, int, str]] = field(default_factory=list)
    nodes: list[tuple[int, int, int, list[str]]] = field(default_factory=list)
    keep: bool = False
    done: list[str] = field(default_factory=list)

    def last_leaf(self, height: int, index: int) -> int:
        return min((index + 1) * self.fanout**height, self.size) - 1

    def send(self, height: int, index: int, digest: str) -> None:
        """A node's digest goes to its parent's label."""
        if height == self.top:
            self.done.append(digest)
            return
        up = index // self.fanout
        heapq.heappush(self.queue, (self.last_leaf(height + 1, up), height + 1, index, digest))

    def leaf(self, index: int, digest: str) -> None:
        """The sweep reaches a leaf, then every node whose label is due."""
        self.send(0, index, digest)
        while self.queue and self.queue[0][0] <= index:
            last, height, child, found = heapq.heappop(self.queue)
            run = [found]
            while self.queue and self.queue[0][:2] == (last, height):
                run.append(heapq.heappop(self.queue)[3])
            if self.keep:
                self.nodes.append((last, height, child, run))
            self.send(height, child // self.fanout, _digest(run))

    def proofs(self, suffix: list[tuple[str, str]]) -> dict[int, list[tuple[str, str]]]:
        """The reversed sweep: the top node starts with ``suffix``; every
        node, in falling label order, sends each child the child's siblings
        and its own suffix. The leaves' messages are their proofs."""
        due: dict[tuple[int, int], list[tuple[str, str]]] = {}
        if not self.nodes:
            return {self.first: suffix}
        due[self.nodes[-1][0], self.nodes[-1][1]] = suffix
        found = {}
        for last, height, child, run in reversed(self.nodes):
            own = due.pop((last, height))
            for i in range(len(run)):
                message = [("".join(run[:i]), "".join(run[i + 1 :])), *own]
                if height == 1:
                    found[child + i] = message
                else:
                    due[self.last_leaf(height - 1, child + i), height - 1] = message
        return found


def _heights(size: int, fanout: int, most: int) -> int:
    n, height = size, 0
    while n > 1 and height < most:
        n, height = -(-n // fanout), height + 1
    return height


def _blocks(batches: Iterator[pa.RecordBatch], fanout: int, epoch: int) -> Iterator[tuple[Block, list[dict], dict]]:
    """The blocks of a sorted partition: the block, its rows, and the row at
    index -1 that comes before them if there is one. One block is held."""
    key, rows, head = None, [], {}

    def block() -> tuple[Block, list[dict], dict]:
        size = rows[0]["size"]
        return Block(rows[0]["block"] * fanout**epoch, size, _heights(size, fanout, epoch), fanout), rows, head

    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            for row in batch.slice(at, OUT_ROWS).to_pylist():
                if key != (row["grp"], row["block"]):
                    if rows:
                        yield block()
                    key, rows, head = (row["grp"], row["block"]), [], {}
                if row["idx"] < 0:
                    head = row
                else:
                    rows.append(row)
    if rows:
        yield block()


def _dealt(rows: DataFrame) -> DataFrame:
    """The external queue: every block's messages in one task, in label
    order."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")


def _block_of(fanout: int, epoch: int) -> Column:
    return F.floor(F.col("idx") / F.lit(fanout**epoch)).cast("long")


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def climb(level: DataFrame, fanout: int, epoch: int) -> DataFrame:
    """One epoch of the forward sweep: ``(grp, idx, size, digest)`` of the
    nodes ``epoch`` heights above ``level``, or of the root."""
    held = level.select("grp", _block_of(fanout, epoch).alias("block"), "idx", "size", "digest")
    schema = to_arrow_schema(level.select("grp", "idx", "size", "digest").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block, rows, _ in _blocks(batches, fanout, epoch):
            for row in rows:
                block.leaf(row["idx"], row["digest"])
            out.append((rows[0]["grp"], rows[0]["block"], -(-block.size // fanout**epoch), block.done[0]))
            if len(out) >= OUT_ROWS:
                yield _arrow(out, schema)
                out = []
        if out:
            yield _arrow(out, schema)

    return _dealt(held).mapInArrow(run, f"grp {spark_type(level, 'grp')}, idx long, size long, digest string")


def descend(level: DataFrame, above: DataFrame, carry: list[str], fanout: int, epoch: int) -> DataFrame:
    """One epoch of the reversed sweep: ``(grp, idx, digest, subroot, *carry,
    proof)`` for the nodes of ``level``, given ``above`` (``grp, idx, subroot,
    proof``), the suffixes of the nodes that ``climb`` makes of it."""
    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    nodes = level.select("grp", _block_of(fanout, epoch).alias("block"), "idx", "size", "digest", *carry,
                         null("string").alias("subroot"), null(PROOF).alias("proof"))
    heads = above.select("grp", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"),
                         null("long").alias("size"), null("string").alias("digest"),
                         *[null(spark_type(level, c)).alias(c) for c in carry], "subroot", "proof")
    names = ["grp", "idx", "digest", *carry, "subroot", "proof"]
    schema = to_arrow_schema(nodes.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, head in _blocks(batches, fanout, epoch):
            block.keep = True
            for row in rows:
                block.leaf(row["idx"], row["digest"])
            proofs = block.proofs([(s["left"], s["right"]) for s in head["proof"]])
            for at in range(0, len(rows), OUT_ROWS):
                yield _arrow([(*(r[c] for c in names[:-2]), head["subroot"],
                               [{"left": a, "right": b} for a, b in proofs[r["idx"]]])
                              for r in rows[at : at + OUT_ROWS]], schema)

    kinds = ", ".join(f"`{c}` {spark_type(nodes, c)}" for c in names)
    return _dealt(nodes.unionByName(heads)).mapInArrow(run, kinds)


def _rise(leaves: DataFrame, fanout: int, epoch: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels where the epochs begin, and the roots ``(grp, digest)``
    that each epoch ends in."""
    levels, roots = [leaves], []
    while True:
        up = materialize(climb(levels[-1], fanout, epoch))
        roots.append(up.where("size = 1").select("grp", "digest"))
        rest = up.where("size > 1")
        if rest.isEmpty():
            return levels, roots
        levels.append(rest)


def _fall(levels: list[DataFrame], roots: list[DataFrame], suffixes: DataFrame | None, carry: list[str], fanout: int,
          epoch: int) -> DataFrame:
    """The reversed sweep over all epochs; ``suffixes`` (``grp, proof``) is
    what each group's root starts with (None: nothing)."""
    named = None if suffixes is None else suffixes.select(F.col("grp").alias("of"), "proof")
    below = None
    for k in range(len(levels) - 1, -1, -1):
        ends = roots[k].withColumn("proof", F.array().cast(PROOF)) if named is None else roots[k].join(
            named, F.col("grp").eqNullSafe(F.col("of")))
        above = ends.select("grp", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "proof")
        if below is not None:
            above = above.unionByName(below.select("grp", "idx", "subroot", "proof"))
        below = descend(levels[k], above, carry if k == 0 else [], fanout, epoch)
        if k:
            below = materialize(below)
    return below


def manifest(records: DataFrame, group_col: str, order_cols: list[str], digest_col: str, carry: tuple[str, ...] = (),
             fanout: int = FANOUT, epoch: int = EPOCH) -> DataFrame:
    """``(grp, idx, digest, *carry, subroot, proof, root)`` per record.

    The records of a group, in the order of ``order_cols`` (nulls first, ties
    by digest, so that the trees do not depend on how rows are stored), are
    the leaves 0, 1, ... of its tree. While several nodes remain, every
    ``fanout`` consecutive ones become the SHA-256 of their joined hex
    digests; what remains is ``subroot``, and the subroots in the order of
    their groups (null first) lead to ``root`` likewise. ``proof`` holds, leaf
    to root, the digests left and right of the path (see ``fold``).

    A null group is a group; repeated records are leaves of their own; a
    record alone in its group is its subroot, and alone in the table its root,
    with an empty proof. An empty table gives no rows. Only digests,
    ``order_cols`` and ``carry`` move, never a text, however long."""
    order = [f"_o{i}" for i in range(len(order_cols))]
    kept = [f"_c{i}" for i in range(len(carry))]
    narrow = records.select(
        F.col(group_col).alias("grp"), F.col(digest_col).alias("digest"),
        *[F.col(c).alias(n) for c, n in zip(order_cols, order)], *[F.col(c).alias(n) for c, n in zip(carry, kept)])
    ranked = running(narrow, ["grp"], [*order, "digest", *kept])
    leaves = materialize(ranked.select("grp", F.col("before").alias("idx"), F.col("whole").alias("size"), "digest", *kept))
    levels, roots = _rise(leaves, fanout, epoch)
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    top = running(subroots.withColumnRenamed("grp", "of"), [], ["of"])
    top = materialize(top.select(F.lit(0).alias("grp"), F.col("before").alias("idx"), F.col("whole").alias("size"), "digest", "of"))
    top_levels, top_roots = _rise(top, fanout, epoch)
    whole = materialize(_fall(top_levels, top_roots, None, ["of"], fanout, epoch))
    found = _fall(levels, roots, whole.select(F.col("of").alias("grp"), "proof"), kept, fanout, epoch)
    root = top_roots[-1].first()
    return found.select("grp", "idx", "digest", *[F.col(n).alias(c) for c, n in zip(carry, kept)], "subroot", "proof",
                        F.lit(root["digest"] if root else None).cast("string").alias("root"))


def verified(proofs: DataFrame, digest_col: str) -> DataFrame:
    """``proofs`` with ``folded_root``, the root that the digests in
    ``digest_col`` lead to over the stored siblings, and ``verified``."""
    folded = proofs.withColumn("folded_root", fold(F.col(digest_col), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def store(records: DataFrame, group_col: str, order_cols: list[str], digest_col: str, path: str,
          fanout: int = FANOUT) -> str:
    """Write the manifest (group, index, digest, subroot, proof) as Parquet
    under ``path`` and return the root; None for an empty table."""
    found = manifest(records, group_col, order_cols, digest_col, fanout=fanout)
    found.write.parquet(path)
    first = found.sparkSession.read.parquet(path).select("root").first()
    return first["root"] if first else None
