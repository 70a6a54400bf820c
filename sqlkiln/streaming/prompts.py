"""Prompt building on a stream of samples.

Cleaning, normalisation, the schema lookup (a stream-static join against
the materialised, size-checked schema table) and rendering are all
stateless, so the batch functions apply unchanged to a streaming DataFrame:
no watermark, no state store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..plans.prompts import pauq_prompts
from ..plans import standins as S
from ..session import shared_dir


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A table, one file or a folder of part files, as a file stream (schema
    taken from the batch read).  Without ``max_files_per_trigger`` all files
    that are there make one micro-batch."""
    batch = S.table(spark, sf_dir, name)
    reader = spark.readStream.schema(batch.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if _is_file(spark, sf_dir, f"{name}.parquet"):
        # One file: a stream watches folders, so it watches this name in one.
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _is_file(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether ``folder/name`` is one file: asked of the file system (a
    listing, not the plan of a table, which may be cached)."""
    root = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{name}").select("path").first()
    return found is not None and found["path"].endswith(f"/{root.rsplit('/', 1)[-1]}/{name}")


def stream_prompts(samples_stream: DataFrame, schemas: DataFrame, phase: str = "test", **kw) -> DataFrame:
    """Streaming (ord, id, db_id, question, query) -> (ord, id, text)."""
    if not samples_stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return pauq_prompts(samples_stream, schemas, phase, **kw)


def run_to_table(df: DataFrame, out_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain a streaming query into parquet in the shared folder (available
    data only, exactly once through the checkpoint) and read it back."""
    spark = df.sparkSession
    out_path = out_path or shared_dir(spark, "stream-out")
    checkpoint = checkpoint or shared_dir(spark, "stream-ckpt")
    q = (
        df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    # No arrived data, no files: still a table of the query's shape.
    try:
        return spark.read.schema(df.schema).parquet(out_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], df.schema)
