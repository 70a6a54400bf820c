"""The training-data pipeline over the documents table: each stage takes
what its predecessor kept, written as Parquet and read again.

In every stage a table without rows stays one, rows repeated with their id are
rows of their own unless a stage says otherwise, texts of any length are taken
whole, and columns besides the ones named here pass through, whatever their
names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlkiln.llm import decontam, langid, mixing, sharding, simhash
from sqlkiln.llm.common import table
from sqlkiln.llm.queries import MIX_TARGETS
from sqlkiln.session import ensure_checkpoint_dir, shared_dir, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
LANGUAGE_SHARE = 0.35
SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts too), or in which
    no learned language has the share it takes; the model learns from the
    table's own languages, and without one no document stays. A null id or
    language decides nothing; copies stay or go together."""
    return langid.keep_identified(docs, langid.fit(docs), least=LANGUAGE_SHARE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group;
    documents without an id come after all others, texts without a word are
    one group, and of rows repeated with id and text one stays."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, radius=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an exact or edited benchmark item. Rows are
    told apart by id and text, null or not; null and empty texts stay, as does
    everything when no item has enough words."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin or repeat documents until the expected tokens of each label
    domain meet the targets; the good domain keeps its tokens. Documents of
    one id and text get the same number of copies; without labels all rows
    stay once, and a null or empty text has no tokens to mix."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), MIX_TARGETS, keep_whole="good")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``vslot`` and ``shard``: equal bytes per shard over fixed virtual
    slots. Only the slot sums are shuffled, never a text. A null id or text
    hashes like an empty one; columns of those names are replaced."""
    return sharding.sharded(docs, SHARDS)


def _ready(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _ready(identify_language)),
    ("simhash_near_dedup", _ready(drop_near_copies)),
    ("decontamination", _ready(decontaminate)),
    ("mixing", _ready(mix_to_targets)),
    ("sharding", _ready(assign_shards)),
]

# Fingerprints, alignments and learned models have no SQL form; the tests
# hold the pipeline against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{name}")
            done.write.parquet(path)
            docs = spark.read.parquet(path)
    return done
