"""Readers for schema catalogs and question/SQL corpora.

The corpora are JSON arrays (or one JSON object for labels), one file or a
folder of them.  A file of any size is read in many tasks (``json_split``);
``ord`` (file order) is fixed at ingestion and travels to every sink.
Malformed JSON and missing required fields are errors, never an empty or
shorter corpus.  ``fmt='jsonl'`` reads JSON lines, whose ``ord`` field gives
the order, and ``fmt='parquet'`` a copy written by ``ingest_json_array``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .json_split import read_elements

CATALOG_FIELDS = (
    "db_id STRING, table_names_original ARRAY<STRING>, column_names_original ARRAY<ARRAY<STRING>>, "
    "column_types ARRAY<STRING>, primary_keys ARRAY<BIGINT>, foreign_keys ARRAY<ARRAY<BIGINT>>, "
    "table_names ARRAY<STRING>, column_names ARRAY<ARRAY<STRING>>"
)
PAUQ_FIELDS = "id STRING, db_id STRING, question STRING, query STRING"
QUESTION_FIELDS = "id STRING, question STRING"
LABEL_FIELDS = "id STRING, sql STRING"

CORPUS_COLUMNS = ["ord", "id", "db_id", "question", "query"]


FAILFAST = {"mode": "FAILFAST"}


def _required(fields: str, what: str):
    """Fail on a row of ``r`` that lacks one of the comma-separated fields."""
    r = F.col("r")
    checked = r
    for name in fields.split(","):
        text = F.concat(F.lit(f"{what} without {name} in "), F.col("file_path"), F.lit(" at position "),
                        F.col("pos").cast("string"))
        checked = F.when(F.col(f"r.{name}").isNull(), F.raise_error(text)).otherwise(checked)
    return checked


def _array(spark: SparkSession, path: str, element_ddl: str, required: str, what: str) -> DataFrame:
    """The objects of JSON arrays; ``ord`` = file rank << 32 | position.  A
    file that is not such an array, or a row without a required field, is an
    error that names the file."""
    found = read_elements(spark, path, "array", what)
    parsed = found.select(F.col("file").alias("file_path"), "file_rank", "pos",
                          F.from_json("text", f"STRUCT<{element_ddl}>", FAILFAST).alias("r"))
    return parsed.select((F.shiftleft(F.col("file_rank").cast("long"), 32) + F.col("pos")).alias("ord"),
                         _required(required, what).alias("r")).select("ord", "r.*")


def _lines(spark: SparkSession, path: str, ddl: str, required: str) -> DataFrame:
    """JSON lines with an ``ord`` field: splittable, strict."""
    rows = spark.read.schema(f"ord BIGINT, {ddl}").json(path, mode="FAILFAST")
    for name in ("ord", *required.split(",")):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.lit(f"a line without {name} in {path}"))))
    return rows


CATALOG_COLUMNS = ["db_id", "table_names_original", "column_names_original", "column_types", "primary_keys",
                   "foreign_keys", "cat_ord"]


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Schema catalog (``tables.json``).  ``table_names`` and
    ``column_names`` must be present (as in the original reader) and are
    dropped; ``db_id`` stays a string even when it looks numeric.
    ``fmt='parquet'`` reads a copy written by ``ingest_json_array``."""
    if fmt == "parquet":
        return spark.read.parquet(path).select(*CATALOG_COLUMNS)
    required = "db_id,table_names,column_names,table_names_original,column_names_original,column_types,primary_keys,foreign_keys"
    if fmt == "jsonl":
        df = _lines(spark, path, CATALOG_FIELDS, required)
    else:
        df = _array(spark, path, CATALOG_FIELDS, required, "catalog entry")
    return df.select(
        "db_id", "table_names_original", "column_names_original", "column_types", "primary_keys", "foreign_keys",
        F.col("ord").alias("cat_ord"),
    )


def read_pauq(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """PAUQ samples: (ord, id, db_id, question, query).  ``fmt='parquet'``
    reads a splittable copy written by ``ingest_json_array``."""
    if fmt == "parquet":
        return spark.read.parquet(path).select(*CORPUS_COLUMNS)
    required = "id,db_id,question,query"
    if fmt == "jsonl":
        return _lines(spark, path, PAUQ_FIELDS, required).select(*CORPUS_COLUMNS)
    return _array(spark, path, PAUQ_FIELDS, required, "sample").select(*CORPUS_COLUMNS)


def read_ehrsql_questions(spark: SparkSession, directory: str, fmt: str = "json") -> DataFrame:
    """``data.json``: a bare list or an object whose ``data`` key holds it;
    ``fmt='jsonl'``: ``data.jsonl``, with ``ord``.  ``fmt='parquet'``:
    ``directory`` holds the ``questions`` copy written by
    ``ingest_json_array(kind='ehrsql')``."""
    root, required = directory.rstrip("/"), "id,question"
    if fmt == "parquet":
        return spark.read.parquet(f"{root}/questions").select("ord", "id", "question")
    if fmt == "jsonl":
        return _lines(spark, f"{root}/data.jsonl", QUESTION_FIELDS, required).select("ord", "id", "question")
    return _array(spark, f"{root}/data.json", QUESTION_FIELDS, required, "question").select("ord", "id", "question")


def read_ehrsql_labels(spark: SparkSession, directory: str, fmt: str = "json") -> DataFrame:
    """``label.json``: one object id -> SQL; (id, sql).  A repeated key keeps
    its last value; a JSON ``null`` stays NULL (the string ``'null'`` marks an
    unanswerable question).  ``fmt='jsonl'`` reads ``label.jsonl``, lines of
    ``ord``, ``id`` and ``sql``; ``fmt='parquet'`` the ``labels`` copy."""
    root = directory.rstrip("/")
    if fmt == "parquet":
        return spark.read.parquet(f"{root}/labels").select("id", "sql")
    if fmt == "jsonl":
        pairs = _lines(spark, f"{root}/label.jsonl", LABEL_FIELDS, "id").select("id", "sql", F.col("ord").alias("at"))
    else:
        found = read_elements(spark, f"{root}/label.json", "object", "label")
        entry = F.element_at(F.map_entries(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "MAP<STRING,STRING>", FAILFAST)), 1)
        pairs = found.select(entry.alias("kv"), F.struct("file_rank", "pos").alias("at")).select(
            F.col("kv.key").alias("id"), F.col("kv.value").alias("sql"), "at")
    last = pairs.groupBy("id").agg(F.max_by(F.struct("sql"), "at").alias("v"))
    return last.select("id", F.col("v.sql").alias("sql"))


def ingest_json_array(spark: SparkSession, path: str, out: str, kind: str = "pauq") -> None:
    """Parse a JSON input once and write a splittable parquet copy.  For
    ``kind='ehrsql'``, ``path`` is the directory with ``data.json`` and
    ``label.json`` and ``out`` receives ``questions`` and ``labels``."""
    if kind == "ehrsql":
        read_ehrsql_questions(spark, path).write.mode("overwrite").parquet(f"{out.rstrip('/')}/questions")
        read_ehrsql_labels(spark, path).write.mode("overwrite").parquet(f"{out.rstrip('/')}/labels")
        return
    readers = {"pauq": read_pauq, "catalog": read_catalog}
    readers[kind](spark, path).write.mode("overwrite").parquet(out)
