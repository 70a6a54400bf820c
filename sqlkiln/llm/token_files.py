"""Token ids as Arrow files of equal-length sequences.

A data set is a folder of Arrow IPC files and a manifest. A file holds record
batches of ``SEQUENCES`` rows with fixed-size lists: ``ids`` (the tokens of
consecutive documents, back to back), ``mask`` (whether a place holds a token)
and ``ends`` (whether it is a document's last). Buffers are not compressed, so
a reader that maps a file gets any sequence as a view of the mapped bytes.
Beside it, a file of the same name ending in ``.docs.arrow`` lists the
documents with their place. A document lies in one file; only a file's last
sequence is padded."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sqlkiln.llm.common import chunks
from sqlkiln.llm.running import running
from sqlkiln.session import materialize

SEQ_LEN = 2048
SEQUENCES = 512  # rows of a record batch
END_ID = 0
# The ids of about so many pieces are remembered by a Python worker (100 MB).
REMEMBERED = 1 << 19
PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s")
ENCODED_BYTES = 8 << 20  # of texts encoded at once: the more, the fewer pieces are looked up
LINES = 1000  # words encoded as one text; in longer texts a word takes more time
# Kinds of UTF-8 bytes: white space but the blank, the blank, letters, digits
# and symbols of ASCII, and bytes with which the white space beyond ASCII
# begins (two to match, or three).
SPACE, BLANK, LETTER, DIGIT, SYMBOL, LEAD = 1, 2, 3, 4, 5, 6
KINDS = np.zeros(256, np.uint8)
for _kind, _bytes in ((SYMBOL, range(33, 127)), (SPACE, b"\t\n\x0b\x0c\r"), (BLANK, b" "), (DIGIT, b"0123456789"),
                      (LETTER, range(65, 91)), (LETTER, range(97, 123)), (LEAD, b"\xc2\xe1\xe2\xe3")):
    KINDS[list(_bytes)] = _kind
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def piece_starts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the ``PIECES`` begin of texts that stand back to back, as UTF-8,
    and their words' parts: runs of Latin letters, digits and symbols, but an
    apostrophe stays with the letters after it, and no part begins or ends
    beside any other character. ``begins`` are the texts' own (the last: the
    end)."""
    kind = KINDS[raw]
    lead = (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC8)  # U+00C0 to U+023F: letters but two
    lead &= (raw[:-1] != 0xC3) | ((raw[1:] != 0x97) & (raw[1:] != 0xB7))
    kind[:-1][lead] = LETTER
    kind[1:][lead] = LETTER
    space = (kind == SPACE) | (kind == BLANK)
    part = (kind >= LETTER) & (kind <= SYMBOL)
    starts = np.zeros(len(kind), bool)
    starts[1:] = (space[1:] & ~space[:-1]) | (~space[1:] & (kind[:-1] == SPACE))
    starts[1:] |= part[1:] & part[:-1] & (kind[1:] != kind[:-1]) & ~((raw[:-1] == ord("'")) & (kind[1:] == LETTER))
    before_word = space[:-1] & ~space[1:]
    before_word[begins[(begins > 0) & (begins < len(kind))] - 1] = False
    starts[:-1] |= before_word
    starts[begins[begins < len(kind)]] = True
    return np.flatnonzero(starts)
PART = "part long, file string, documents long, tokens long, sequences long"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there (local paths may come
    as ``file:/...``)."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class Encoder:
    """Whole texts to ids with a tokenizer file, no special tokens added.

    Byte-level tokenizers without a normalizer cut a text into words with the
    blank before them, and runs of white space, before they merge anything
    (``piece_starts`` cuts no finer), so such pieces are encoded once and
    remembered, the first ``remembered`` of them; any other tokenizer, and a
    text with an added token or one of the separators that Python alone counts
    as white space, goes through whole. Ids are the same either way."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        said = json.loads(self.tokenizer.to_str())
        pre = said.get("pre_tokenizer") or {}
        added = said.get("added_tokens") or []
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not said.get("normalizer") and not said.get("truncation") and not said.get("padding")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 for t in added))
        self.whole = [c.encode() for c in ("\x1c", "\x1d", "\x1e", "\x1f", *(t["content"] for t in added))]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_piece = self.by_piece and len(line) == 1
        self.line = line[0] if line else None
        self.known: dict[bytes, bytes] = {}
        self.remembered = remembered

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces; words go to the tokenizer as lines of a text,
        as a line break is always a token of its own there."""
        spaces = [p for p in pieces if p.isspace()]
        found = dict(zip(spaces, self._ids([p.decode() for p in spaces])))
        words = [p for p in pieces if not p.isspace()]
        for at in range(0, len(words), LINES):
            lines = words[at : at + LINES]
            ids = np.frombuffer(self._ids([b"\n".join([*lines, b""]).decode()])[0], self.dtype)
            ends = (np.flatnonzero(ids == self.line) * ids.itemsize).tolist()
            starts = [0, *(e + ids.itemsize for e in ends)]
            raw = ids.tobytes()
            found.update({p: raw[a:b] for p, a, b in zip(lines, starts, ends)})
        return found

    def _looked_up(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of some different pieces."""
        known = self.known
        found = list(map(known.get, pieces))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        fresh = self._pieces([pieces[i] for i in gaps])
        for i in gaps:
            found[i] = fresh[pieces[i]]
        known.update(islice(fresh.items(), max(0, self.remembered - len(known))))
        return found

    def _by_rule(self, text: str) -> bytes:
        """A text with white space beyond ASCII, cut by the expression."""
        pieces = [p.encode() for p in PIECES.findall(text)]
        # Python's bytes know no such space, so runs of it go by themselves.
        wide = {p: self._ids([p.decode()])[0] for p in set(pieces) if p.decode().isspace()}
        words = [p for p in dict.fromkeys(pieces) if p not in wide]
        ids = wide | dict(zip(words, self._looked_up(words)))
        return b"".join(map(ids.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of ``dtype``."""
        return self.encode_utf8([t.encode() for t in texts])

    def encode_utf8(self, texts: list[bytes]) -> list[bytes]:
        """The same of texts as UTF-8 bytes. The pieces of all texts are cut
        and told apart as one Arrow column, so Python sees each once."""
        if not self.by_piece:
            return self._ids([t.decode() for t in texts])
        raw, begins = b"".join(texts), np.cumsum([0, *map(len, texts)])
        kind = KINDS[np.frombuffer(raw, np.uint8)]
        lead = np.unique(np.searchsorted(begins, np.flatnonzero(kind == LEAD), side="right") - 1).tolist()
        odd = {k: self._by_rule for k in lead if WIDE_SPACE.search(texts[k].decode())}
        odd |= {k: lambda t: self._ids([t])[0] for k, t in enumerate(texts) if any(c in t for c in self.whole)}
        if odd:
            plain = self._of_plain([b"" if k in odd else t for k, t in enumerate(texts)])
            return [odd[k](texts[k].decode()) if k in odd else ids for k, ids in enumerate(plain)]
        return self._of_plain(texts)

    def _of_plain(self, texts: list[bytes]) -> list[bytes]:
        raw, begins = b"".join(texts), np.cumsum([0, *map(len, texts)])
        if not raw:
            return [b""] * len(texts)
        starts = piece_starts(np.frombuffer(raw, np.uint8), begins)
        offsets = pa.array(np.append(starts, len(raw)), pa.int32())
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self._looked_up(column.dictionary.to_pylist()), pa.binary()).take(column.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32)
        cuts = ends[np.searchsorted(starts, begins)].tolist()
        data = ids.buffers()[2].to_pybytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Writer:
    """The sequences of one file; at most one record batch is held."""

    def __init__(self, folder: str, name: str, seq_len: int, dtype: type, id_type: pa.DataType):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        self.seq_len, self.dtype, self.name = seq_len, dtype, name
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)),
                                 ("mask", pa.list_(pa.bool_(), seq_len)), ("ends", pa.list_(pa.bool_(), seq_len))])
        self.sink = fs.open_output_stream(f"{base}/{name}.arrow")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.doc_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.doc_sink = fs.open_output_stream(f"{base}/{name}.docs.arrow")
        self.doc_file = pa.ipc.new_file(self.doc_sink, self.doc_schema)
        self.room = SEQUENCES * seq_len
        self.ids, self.ends, self.used = np.zeros(self.room, dtype), np.zeros(self.room, bool), 0
        self.documents = self.tokens = self.sequences = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.tokens, len(ids)))
        self.documents += 1
        self.tokens += len(ids)
        while len(ids):
            n = min(len(ids), self.room - self.used)
            self.ids[self.used : self.used + n] = ids[:n]
            self.used += n
            ids = ids[n:]
            if not len(ids):
                self.ends[self.used - 1] = True
            if self.used == self.room:
                self._flush()
        if len(self.rows) >= 1 << 14:
            self._flush_rows()

    def _list(self, values: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(values), self.seq_len)

    def _flush(self) -> None:
        n = -(-self.used // self.seq_len)
        if n:
            to = n * self.seq_len
            mask = np.arange(to) < self.used
            self.file.write_batch(pa.RecordBatch.from_arrays(
                [self._list(self.ids[:to]), self._list(mask), self._list(self.ends[:to])], schema=self.schema))
        self.sequences += n
        self.ids[:] = 0
        self.ends[:] = False
        self.used = 0

    def _flush_rows(self) -> None:
        if self.rows:
            self.doc_file.write_batch(pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.doc_schema)], schema=self.doc_schema))
        self.rows = []

    def close(self) -> None:
        self._flush()
        self._flush_rows()
        for f in (self.file, self.sink, self.doc_file, self.doc_sink):
            f.close()


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text, add ``end_id`` to each, and write the ids in
    the order of their documents (null ids first; ties by the text's hash).
    Returns the manifest ``(part, file, documents, tokens, sequences)``, which
    is also written, under ``path/manifest``.

    Null text is empty and gives the end id alone. Repeated rows are documents
    of their own. An empty table gives an empty manifest. One shuffle, by id
    range: a hot id with several texts or rows is spread over tasks. A file is
    named after its task attempt and the manifest lists those of the attempts
    that Spark committed, so a lost executor leaves at most files that nobody
    reads. ``path`` must be seen by all executors."""
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(F.col("id").asc_nulls_first(), "tie", "nth").sortWithinPartitions(
        F.col("id").asc_nulls_first(), "tie", "nth")
    id_type = to_arrow_schema(keyed.select("id").schema).field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, enc = None, encoder(tokenizer)
        task = TaskContext.get()
        last = np.array([end_id], enc.dtype)
        for batch in batches:
            ids = batch.column(0)
            for at, texts in chunks(batch.column(1), ENCODED_BYTES):
                found = enc.encode_utf8(texts)
                for doc_id, mine in zip(ids.slice(at, len(texts)).to_pylist(), found):
                    if writer is None:
                        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                        writer = _Writer(f"{path}/data", name, seq_len, enc.dtype, id_type)
                    writer.add(doc_id, np.concatenate((np.frombuffer(mine, enc.dtype), last)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([task.partitionId()], pa.int64()), "file": [f"{path}/data/{writer.name}"],
                "documents": [writer.documents], "tokens": [writer.tokens], "sequences": [writer.sequences]})

    dealt.select("id", "text").mapInArrow(run, PART).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(PART).parquet(f"{path}/manifest")


class Sequences:
    """Random access to one file: ``reader[i]`` is ``(ids, mask)`` of its i-th
    sequence. On a local or mounted file system they are views of the mapped
    file; otherwise of the record batch that was read."""

    def __init__(self, file: str):
        fs, base = self.fs, self.base = _filesystem(file)
        mapped = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(f"{base}.arrow") if mapped else fs.open_input_file(f"{base}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches
        self.last: tuple[int, pa.RecordBatch] = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.last[0] != k:
            self.last = (k, self.file.get_batch(k))
        return self.last[1]

    def __len__(self) -> int:
        return (self.batches - 1) * SEQUENCES + self.batch(self.batches - 1).num_rows if self.batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch, at = self.batch(i // SEQUENCES), i % SEQUENCES
        ids, mask = (batch.column(k).slice(at, 1).flatten() for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(id, start in the file, ids) of every document, in order, cut
        where the file marks their ends."""
        listed = pa.ipc.open_file(self.fs.open_input_file(f"{self.base}.docs.arrow"))
        rows = (r for k in range(listed.num_record_batches) for r in listed.get_batch(k).to_pylist())
        held: list[np.ndarray] = []
        for k in range(self.batches):
            batch = self.batch(k)
            ids, mask, ends = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(3))
            at = 0
            for end in np.flatnonzero(ends & mask).tolist():
                row = next(rows)
                found = np.concatenate([*held, ids[at : end + 1]])
                held, at = [], end + 1
                if len(found) != row["n_tokens"]:
                    raise ValueError(f"{self.base}: document {row['doc_id']} has {len(found)} tokens, not {row['n_tokens']}")
                yield row["doc_id"], row["start"], found
            held.append(ids[at:][mask[at:]])


def read(spark: SparkSession, path: str, id_type: str, columns: str,
         derive: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``(id, start, n_tokens, *columns)`` per document, read back from the
    files of ``path``: ``start`` counts the tokens of all documents before it,
    and ``derive`` makes the columns from a document's ids. Files are dealt
    out, one row each; the ids need not leave the task."""
    files = running(spark.read.schema(PART).parquet(f"{path}/manifest"), [], ["part"], "tokens")
    files = materialize(files.select("file", F.col("before").alias("base")))
    fields = f"id {id_type}, start long, n_tokens long, {columns}"
    schema = to_arrow_schema(spark.createDataFrame([], fields).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns)):
                out, held = [], 0
                for doc_id, start, ids in Sequences(file).documents():
                    row = derive(ids)
                    out.append((doc_id, base + start, len(ids), *row))
                    held += sum(len(v) if hasattr(v, "__len__") else 1 for v in row)
                    if len(out) >= 4096 or held >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return files.repartition(max(1, files.count()), "file").mapInArrow(run, fields)


def read_ids(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``(id, start, n_tokens, ids)`` with the ids as an array."""
    return read(spark, path, id_type, "ids array<int>", lambda ids: (ids.astype(np.int32),))


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_digests(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)``."""
    return read(spark, path, id_type, "ids_crc32 long", lambda ids: (crc32_of(ids),))
