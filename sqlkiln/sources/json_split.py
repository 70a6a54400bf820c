"""JSON arrays and objects read in many tasks.

Spark's text reader splits a file of any size at a one-character line
separator: ``}`` ends every object of an array, ``,`` every member of an
object.  A split may begin anywhere, inside a string or ten levels deep, so
the elements are found in two passes.

1. Every split is scanned as if it began outside a string and as if it began
   inside one; it reports, for both, whether it ends inside a string, how far
   it moves the nesting depth, and how many pieces end at each relative depth.
   The driver folds these reports (one row per split) in file order into the
   true start of every split.
2. Every split is scanned again from its true start and hands out the texts of
   its elements with their position.  An element that crosses a border comes
   as one part per split, and only such parts are shuffled to be joined.

The splits of both passes must agree, so the second is run at once, and its
rows are checkpointed; if executors came or went in between, the passes are
repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..batches import piece_bounds, sizes
from ..session import DEFAULT_BROADCAST_BYTES, materialize

STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
STRING_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
NOT_BRACKET = re.compile(r"[^{}\[\]]+")
EVENT = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\]]', re.S)
KEY_BEFORE = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"\s*:\s*$', re.S)
SEPARATOR = {"array": "}", "object": ","}
WRAPPED_KEY = "data"
OUT_ROWS = 4096
PIECE_BYTES = 1 << 20  # of texts, in Python and in a batch handed out, besides one
TRIES = 3
CHANGED = "splits changed between two passes"


def bare(text: str, quoted: bool) -> tuple[bool, str]:
    """(does it end inside a string, the text without its strings)."""
    if quoted:
        rest = STRING_REST.match(text)
        if rest is None:
            return True, ""
        text = text[rest.end() :]
    left = STRING.sub("", text)
    at = left.find('"')
    return (False, left) if at < 0 else (True, left[:at])


@lru_cache(maxsize=4096)
def shape(brackets: str) -> tuple[int, int]:
    """(net change of depth, lowest depth on the way) of a bracket string."""
    depth = low = 0
    for c in brackets:
        depth += 1 if c in "{[" else -1
        low = min(low, depth)
    return depth, low


@dataclass
class Scan:
    """What a split does to a start that is outside or inside a string."""

    quoted: bool
    depth: int = 0
    ends: dict[int, int] = field(default_factory=dict)

    def take(self, text: str, separator: str) -> None:
        self.quoted, left = bare(text, self.quoted)
        self.depth += shape(NOT_BRACKET.sub("", left))[0]
        if left.endswith(separator) and not self.quoted:
            self.ends[self.depth] = self.ends.get(self.depth, 0) + 1


@dataclass(frozen=True)
class Start:
    """The state in which a split begins: inside a string or not, its depth,
    whether inside the container whose elements are wanted, how many elements
    ended before it, and how many the file has."""

    quoted: bool
    depth: int
    active: bool
    position: int
    total: int = 0


class Elements:
    """The element texts of one split, read from its true start.

    ``target`` is the depth inside the wanted container: 1, or 2 when it is
    the value of the key ``data`` of an object.  Texts between elements (blanks
    and commas of an array) go before the element that follows them."""

    def __init__(self, kind: str, target: int, start: Start):
        self.separator, self.members, self.target = SEPARATOR[kind], kind == "object", target
        self.quoted, self.depth, self.active, self.position = start.quoted, start.depth, start.active, start.position
        self.held: list[str] = []
        self.counts: list[list] = [[None, 0]]  # (is it the wanted one, elements ended) per container

    def take(self, text: str) -> Iterator[tuple[int, str]]:
        quoted, left = bare(text, self.quoted)
        net, low = shape(NOT_BRACKET.sub("", left))
        if self.depth >= self.target and self.depth + low >= self.target:
            self.quoted, self.depth = quoted, self.depth + net
            ended = not quoted and self.depth == self.target and left.endswith(self.separator)
            if self.active:
                self.held.append(text[:-1] if ended and self.members else text)
            if ended:
                yield from self._end()
            return
        yield from self._walk(text)

    def _end(self) -> Iterator[tuple[int, str]]:
        self.counts[-1][1] += 1
        if self.active:
            yield self.position, "".join(self.held)
            self.position += 1
            self.held = []

    def _walk(self, text: str) -> Iterator[tuple[int, str]]:
        """Bracket by bracket, where a fragment crosses the target depth."""
        at = begin = 0
        if self.quoted:
            rest = STRING_REST.match(text)
            if rest is None:
                if self.active:
                    self.held.append(text)
                return
            at, self.quoted = rest.end(), False
        for event in EVENT.finditer(text, at):
            c = event[0]
            if c[0] == '"':
                self.quoted = not STRING.fullmatch(c)
            elif c in "{[":
                self.depth += 1
                if self.depth == self.target:
                    self.active, begin = self._wanted(text[: event.start()], c), event.end()
                    self.counts.append([self.active, 0])
            else:
                self.depth -= 1
                if self.depth == self.target - 1 and self.active:
                    self.held.append(text[begin : event.start()])
                    if self.members:
                        yield from self._end()
                    elif "".join(self.held).strip():
                        yield self.position, "".join(self.held)  # no element; its text tells
                    self.active, self.held = False, []
        ended = not self.quoted and self.depth == self.target and text.endswith(self.separator)
        if self.active:
            self.held.append(text[begin:-1] if ended and self.members else text[begin:])
        if ended:
            yield from self._end()

    def _wanted(self, before: str, bracket: str) -> bool:
        if self.members:
            return bracket == "{"
        if self.target == 1:
            return bracket == "["
        key = KEY_BEFORE.search(before)
        return bracket == "[" and key is not None and key[1] == WRAPPED_KEY


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """((file, start), is it new, rows of it) runs of a task's batches."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("file"), batch.column("start")
        other = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1]))
        ends = [*(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for at, end in zip([0, *ends], ends):
            key = (files[at].as_py(), starts[at].as_py())
            yield key, key != last, batch.slice(at, end - at)
            last = key


def _texts(rows: pa.RecordBatch, separator: str) -> Iterator[str]:
    values = rows.column("value")
    for at, end in piece_bounds(sizes(values), PIECE_BYTES):
        for text in values.slice(at, end - at).to_pylist():
            yield text + separator


def _fragments(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path, lineSep=SEPARATOR[kind]).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), "value")


REPORT = ("file string, start long, size long, bytes long, fragments long, head string, "
          "quoted array<boolean>, depth array<long>, ends array<map<long,long>>")


def _reports(fragments: DataFrame, kind: str) -> DataFrame:
    separator = SEPARATOR[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, scans = None, ()

        def report() -> pa.RecordBatch:
            columns = {**row, "quoted": [s.quoted for s in scans], "depth": [s.depth for s in scans],
                       "ends": [list(s.ends.items()) for s in scans]}
            types = {"file": pa.string(), "head": pa.string(), "quoted": pa.list_(pa.bool_()),
                     "depth": pa.list_(pa.int64()), "ends": pa.list_(pa.map_(pa.int64(), pa.int64()))}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))

        for (file, start), new, rows in _splits(batches):
            if new:
                if row is not None:
                    yield report()
                row = {"file": file, "start": start, "size": rows.column("size")[0].as_py(), "bytes": 0, "fragments": 0, "head": ""}
                scans = (Scan(False), Scan(True))
            row["bytes"] += (pc.sum(pc.binary_length(rows.column("value"))).as_py() or 0) + rows.num_rows
            row["fragments"] += rows.num_rows
            for text in _texts(rows, separator):
                if not row["head"]:
                    row["head"] = text.lstrip()[:1]
                for scan in scans:
                    scan.take(text, separator)
        if row is not None:
            yield report()

    return fragments.mapInArrow(run, REPORT)


class MalformedJson(PySparkException):
    """A file that does not hold what the reader was asked for."""


def _starts(reports: list, kind: str, what: str) -> tuple[dict[tuple[str, int], Start], dict[str, int]]:
    """Fold the reports of each file in order: the start of every split, and
    the target depth of every file."""
    starts: dict[tuple[str, int], Start] = {}
    targets: dict[str, int] = {}
    files: dict[str, list] = {}
    for r in reports:
        files.setdefault(r["file"], []).append(r)
    for file, rows in files.items():
        rows.sort(key=lambda r: r["start"])
        head = next((r["head"] for r in rows if r["head"]), "")
        target = 2 if kind == "array" and head == "{" else 1
        if head != ("{" if kind == "object" or target == 2 else "["):
            raise MalformedJson(f"no JSON {kind} of {what}s in {file}")
        targets[file] = target
        quoted, depth, position = False, 0, 0
        for r in rows:
            starts[file, r["start"]] = Start(quoted, depth, depth >= target and target == 1, position)
            k = int(quoted)
            ends = dict(r["ends"][k]) if r["ends"][k] else {}
            position += ends.get(target - depth, 0)
            quoted, depth = r["quoted"][k], depth + r["depth"][k]
        # The text reader does not tell whether the last separator was there;
        # the byte count does (but not of a compressed file).
        if kind == "array" and not quoted and sum(r["bytes"] for r in rows) != rows[0]["size"] and depth == -1:
            depth = 0
        if depth != 0 or quoted:
            raise MalformedJson(f"no JSON {kind} of {what}s in {file}: it ends inside {'a string' if quoted else 'an element'}")
        total = position + (1 if kind == "object" else 0)
        for r in rows:
            s = starts[file, r["start"]]
            starts[file, r["start"]] = Start(s.quoted, s.depth, s.active, s.position, total)
    return starts, targets


COUNTS = "file string, start long, containers array<struct<wanted:boolean,elements:long>>"


def _containers(fragments: DataFrame, starts: dict[tuple[str, int], Start]) -> DataFrame:
    """For files whose array is the value of a key: the containers that each
    split enters at the depth of the wanted one, with the elements that end
    there (the first entry: in the container it begins in)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scan = None, None

        def report() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("wanted", pa.bool_()), ("elements", pa.int64())]))
            found = [{"wanted": w, "elements": n} for w, n in scan.counts]
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([found], kind)],
                                              names=["file", "start", "containers"])

        for at, new, rows in _splits(batches):
            if new:
                if scan is not None:
                    yield report()
                key, scan = at, Elements("array", 2, starts[at])
            for text in _texts(rows, SEPARATOR["array"]):
                for _ in scan.take(text):
                    pass
                scan.held = []
        if scan is not None:
            yield report()

    return fragments.mapInArrow(run, COUNTS)


def _placed(starts: dict[tuple[str, int], Start], reports: list, what: str) -> dict[tuple[str, int], Start]:
    """The starts of wrapped files: only elements of the wanted container
    count."""
    files: dict[str, list] = {}
    for r in reports:
        files.setdefault(r["file"], []).append(r)
    placed = {}
    for file, rows in files.items():
        active, position, wanted = False, 0, 0
        for r in sorted(rows, key=lambda r: r["start"]):
            s = starts[file, r["start"]]
            placed[file, r["start"]] = Start(s.quoted, s.depth, active and s.depth >= 2, position)
            for k, c in enumerate(r["containers"]):
                active = active if k == 0 else c["wanted"]
                wanted += k > 0 and c["wanted"]
                position += c["elements"] if active else 0
        if wanted != 1:
            raise MalformedJson(f"no JSON array of {what}s in {file}: it has {wanted} lists named {WRAPPED_KEY}")
        for r in rows:
            s = placed[file, r["start"]]
            placed[file, r["start"]] = Start(s.quoted, s.depth, s.active, s.position, position)
    return placed


PIECES = "file string, start long, pos long, total long, whole boolean, text string"


def _found(batches: Iterator[pa.RecordBatch], kind: str, starts: dict[tuple[str, int], Start],
           targets: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_pieces`` of a task, in batches of ``PIECE_BYTES``."""
    names = ["file", "start", "pos", "total", "whole", "text"]
    out: list[tuple] = []
    held = 0
    key, scan, begin = None, None, None

    def batch() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def rest() -> None:
        left = "".join(scan.held)
        if left:
            out.append((*key, scan.position, begin.total, False, left))

    for at, new, rows in _splits(batches):
        if new:
            if scan is not None:
                rest()
            if at not in starts:
                raise ValueError(f"{CHANGED} over {at[0]}")
            key, begin = at, starts[at]
            scan = Elements(kind, targets[at[0]], begin)
            open_ = begin.active  # the first element may have begun earlier
        for text in _texts(rows, SEPARATOR[kind]):
            for position, found in scan.take(text):
                out.append((*key, position, begin.total, not (open_ and position == begin.position), found))
                held += len(found)
            if len(out) >= OUT_ROWS or held >= PIECE_BYTES:
                yield batch()
                out, held = [], 0
    if scan is not None:
        rest()
    if out:
        yield batch()


def _pieces(fragments: DataFrame, kind: str, starts: dict[tuple[str, int], Start], targets: dict[str, int]) -> DataFrame:
    """``(file, start, pos, total, whole, text)``: the elements that lie in a
    split, and the parts of those that cross its borders."""
    return fragments.mapInArrow(lambda batches: _found(batches, kind, starts, targets), PIECES)


def _elements(fragments: DataFrame, kind: str, what: str) -> tuple[DataFrame, list[str]]:
    reports = _reports(fragments, kind).collect()
    starts, targets = _starts(reports, kind, what)
    wrapped = [f for f, t in targets.items() if t == 2]
    if wrapped:
        some = fragments if len(wrapped) == len(targets) else fragments.where(F.col("file").isin(wrapped))
        starts = starts | _placed(starts, _containers(some, starts).collect(), what)
    return materialize(_pieces(fragments, kind, starts, targets)), sorted(targets)


def read_elements(spark: SparkSession, path: str, kind: str, what: str) -> DataFrame:
    """``(file, file_rank, pos, text)`` of the elements of every JSON file
    under ``path``: the objects of an ``array`` (or of the array under the key
    ``data`` of an object), or the ``"key": value`` members of an ``object``,
    as JSON text, with their position.  Files rank by name.

    A file that holds nothing of the kind, ends early, or has anything but one
    comma between elements is an error that names the file, here or in the
    query that reads the rows.  Elements of any length are whole."""
    fragments = _fragments(spark, path, kind)
    for left in range(TRIES - 1, -1, -1):
        try:
            found, files = _elements(fragments, kind, what)
            break
        except PySparkException as e:
            if not left or CHANGED not in str(e):
                raise
    # Files without a byte give no fragment; the listing has them.
    slashes = re.compile(r"^(\w+):/+")  # the listing and the rows spell "file:/" apart
    silent = {slashes.sub(r"\1:/", f) for f in fragments.inputFiles()} - {slashes.sub(r"\1:/", f) for f in files}
    if silent:
        raise MalformedJson(f"no JSON {kind} of {what}s in {min(silent)}: it is empty")
    parts = found.where("not whole").groupBy("file", "pos", "total").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text"))
    rows = found.where("whole").select("file", "pos", "total", "text").unionByName(parts)
    # One comma before every element but the first; members are cut at theirs.
    lead = r"^[ \t\r\n]*(,?)[ \t\r\n]*"
    rows = rows.select("file", "pos", "total", F.regexp_extract("text", lead, 1).alias("comma"),
                       F.regexp_replace("text", lead, "").alias("text"))
    due = F.when((F.col("pos") == 0) | F.lit(kind == "object"), "").otherwise(",")
    last = F.col("total") if kind == "array" else F.when(F.col("total") == 1, 0)  # "[ ]" and "{ }" have a blank
    rows = rows.where(~((F.col("text") == "") & (F.col("comma") == "") & F.coalesce(F.col("pos") == last, F.lit(False))))
    good = (F.col("comma") == due) & (F.col("pos") < F.col("total")) & F.col("text").startswith("{" if kind == "array" else '"')
    error = F.concat(F.lit(f"no JSON {kind} of {what}s in "), F.col("file"), F.lit(": malformed at element "), F.col("pos").cast("string"))
    # From Arrow, as rows of a list would go through Python workers of their own.
    ranks = spark.createDataFrame(pa.table({"file": pa.array(files, pa.string()), "file_rank": pa.array(range(len(files)), pa.int32())}))
    if sum(len(f) + 8 for f in files) <= DEFAULT_BROADCAST_BYTES:
        ranks = F.broadcast(ranks)
    return rows.join(ranks, "file").select("file", "file_rank", "pos", F.when(good, F.col("text")).otherwise(F.raise_error(error)).alias("text"))
