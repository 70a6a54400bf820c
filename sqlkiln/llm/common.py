"""Shared pieces of the training-data operators: table readers, folds, and
Arrow batch helpers that keep a Python worker's memory bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Texts in one Arrow batch are handed to numpy in pieces of about this size.
CHUNK_BYTES = 2 * 1024 * 1024
# Words are runs of anything but ASCII white space (bytes.split() agrees).
NOT_SPACE = r"[^\x20\x09-\x0D]"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the
    empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def words(text: Column) -> Column:
    """The white-space separated words of a text (null or blank: none)."""
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8 bytes) pieces of a string column; a text
    longer than ``limit`` is a piece of its own. Null becomes b''."""
    at, piece, held = 0, [], 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        data = value.as_py() or b""
        if piece and held + len(data) > limit:
            yield at, piece
            at, piece, held = i, [], 0
        piece.append(data)
        held += len(data)
    if piece:
        yield at, piece


def row_pieces(batch: pa.RecordBatch, weight: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch whose ``weight`` column (a count) sums to at
    most ``most``; a heavier row is a piece of its own."""
    at, held = 0, 0
    for i, n in enumerate(batch.column(batch.schema.get_field_index(weight)).to_pylist()):
        if i > at and held + (n or 0) > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if batch.num_rows > at:
        yield batch.slice(at)


def spark_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def unused_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """The id of a row; a null id is replaced by a stand-in made from the
    text, which sorts after all real ids."""
    spare = F.lit(1 << 62) + F.xxhash64(F.col(text_col)).bitwiseAND((1 << 61) - 1)
    if spark_type(docs, id_col) in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(id_col).cast("long"), spare)
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("￿"), spare.cast("string")))
