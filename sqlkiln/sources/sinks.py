"""Writers for prompt datasets, scored results and prediction lines."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..batches import piece_bounds, sizes
from ..operators.confidence import results as last_results
from ..session import broadcast_if_small
from .json_split import PIECE_BYTES


def write_prompts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prompt dataset ``(ord, id, text)`` as parquet."""
    df.select("ord", "id", "text").write.mode(mode).parquet(path)


def write_json_arrays(df: DataFrame, path: str, per_file: int = 5000, key: str = "ord") -> None:
    """Rows as a folder of JSON arrays, the input shape of the readers: one
    array per file, of the rows whose ``key`` hashes alike (about
    ``per_file``, so that no array outgrows a task)."""
    files = max(1, -(-df.count() // per_file))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    arrays = df.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("__file"), F.col(key).alias("__key"), row.alias("__row"))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__key", "__row"))),
                                                         lambda r: r["__row"]), ","), F.lit("]"))
    made = arrays.groupBy("__file").agg(text.alias("value")).select("value")
    made.write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as one array, in batches of ``PIECE_BYTES``."""
    lead = "["
    for batch in batches:
        for at, end in piece_bounds(sizes(batch.column(0)), PIECE_BYTES):
            found = pa.array([lead, *[","] * (end - at - 1)])
            rows = batch.column(0).slice(at, end - at)
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(found, rows, "")], names=["value"])
            lead = ","
    if lead == ",":
        yield pa.RecordBatch.from_pydict({"value": ["]"]})


def write_json_parts(df: DataFrame, path: str, key: str = "ord") -> None:
    """Rows in the order of ``key`` as a folder of JSON arrays, one per range
    of it, of any size: a task streams its rows into its file, so nothing is
    gathered.  The readers split such files again."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    lines = df.orderBy(key).select(row.alias("value"))

    made = lines.mapInArrow(_bracketed, "value string")
    if df.isEmpty():  # else Spark writes a file without a byte
        made = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    made.write.mode("overwrite").text(path)


def write_json_objects(df: DataFrame, path: str, key: str, value: str, per_file: int = 5000) -> None:
    """Rows as a folder of JSON objects ``key -> value``, one per file."""
    files = max(1, -(-df.count() // per_file))
    pair = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    keyed = df.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("__file"), pair.alias("__pair"))
    text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list("__pair"))), {"ignoreNullFields": "false"})
    keyed.groupBy("__file").agg(text.alias("value")).select("value").write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """``id -> (sql, score)``: one row per id, the last occurrence wins (the
    original writes a dictionary).  Parquet or JSON lines instead of pickle."""
    out = last_results(df).select("id", "sql", "score")
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt must be 'parquet' or 'json'")
    getattr(out.write.mode(mode), fmt)(path)


def _fs(spark: SparkSession, path: str):
    """Hadoop's view of a path: any file system that Spark itself can use."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def write_checked(df: DataFrame, path: str, checks: list[Observation], fmt: str = "parquet") -> None:
    """Write ``df`` and commit it only if none of the ``checks`` (given as
    ``on_missing`` to the lookups that ``df`` is made of) saw a row without a
    match: one pass over the data, no join before the join.  The rows are
    written beside ``path`` and moved there at the end; a failed check leaves
    no output and raises ``KeyError`` with the count and an example.  ``path``
    must not exist."""
    spark = df.sparkSession
    fs, final = _fs(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}-uncommitted-{uuid.uuid4().hex}"
    _, begun = _fs(spark, staging)
    try:
        getattr(df.write, fmt)(staging)
        for check in checks:
            seen = check.get
            if seen["unmatched"]:
                raise KeyError(f"{seen['unmatched']} rows without {seen['example']}")
        if not fs.rename(begun, final):
            raise FileExistsError(path)
    finally:
        fs.delete(begun, True)


MANIFEST = "_manifest"


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One SQL per line in dataset order, duplicates kept.  A range sort on
    ``ord`` makes part files follow each other in order (part-00000 first); a
    manifest written after them lists each file's place, its line count and
    the lines before it, so that the order is stored and not only implied by
    names.  A line break inside a statement is an error."""
    sql = F.coalesce("sql", F.lit(""))
    line = F.when(sql.contains("\n"), F.raise_error(F.lit("a prediction holds a line break"))).otherwise(sql)
    df.orderBy("ord").select(line.alias("value")).write.mode(mode).text(path)
    spark = df.sparkSession
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    counts = spark.read.text(path).groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    # One row per file.
    before = F.sum("lines").over(Window.orderBy("file")) - F.col("lines")
    counts.select("file", "lines", before.alias("first_line")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MANIFEST}")


def read_predictions(spark, path: str) -> DataFrame:
    """``(line, sql)``: the lines of a prediction folder with their number in
    the whole data set, from 0, by its manifest.  Each file is read by one
    task, as it was written by one; a file that does not hold the lines the
    manifest says is an error."""
    files = spark.read.text(path, wholetext=True).select(
        F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), "value").where("value <> ''")
    listed = spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")
    lines = F.split(F.regexp_replace("value", "\\n\\z", ""), "\n")
    met = files.join(broadcast_if_small(listed), "file", "full").withColumn("found", lines)
    wrong = F.raise_error(F.concat(F.lit("not the lines of the manifest: "), F.col("file")))
    checked = F.when(F.size("found") == F.col("lines"), F.col("found")).otherwise(wrong)
    each = met.select("first_line", F.posexplode(checked).alias("at", "sql"))
    return each.select((F.col("first_line") + F.col("at")).alias("line"), "sql")


def output_name(test_path: str, one_batch: bool, kind: str) -> str:
    """File names of the original: ``<stem>_inference_result.pkl`` and
    ``<stem>_sql_predictions.txt``; in one-batch mode the text name repeats
    the suffix (``<stem>_one_batch_inference_result_one_batch_sql_predictions.txt``).
    ``kind`` is ``'results'`` or ``'predictions'``."""
    stem = os.path.basename(test_path).split(".")[0]
    results = f"{stem}_one_batch_inference_result.pkl" if one_batch else f"{stem}_inference_result.pkl"
    if kind == "results":
        return results
    if kind != "predictions":
        raise ValueError("kind must be 'results' or 'predictions'")
    base = results.split(".")[0]
    return f"{base}_one_batch_sql_predictions.txt" if one_batch else f"{base}_sql_predictions.txt"


def output_name_column(test_path: Column, one_batch: bool, kind: str) -> Column:
    """``output_name`` of a column of paths."""
    stem = F.substring_index(F.substring_index(test_path, "/", -1), ".", 1)
    return F.concat(stem, F.lit(output_name("", one_batch, kind)))
