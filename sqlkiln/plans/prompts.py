"""Prompt datasets end to end: corpus + catalog -> (ord, id, text).

Order of work: filter first (pushed to the scan), clean and normalise the
per-row text, attach the schema string last (it repeats per sample and
dominates the bytes), render, project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import catalog as cat_ops
from ..operators.corpus import clean_questions, normalize_sql
from ..operators.joins import OnMissing, attach_labels, attach_schema, attach_schema_const
from ..operators.prompts import (
    DEFAULT_TEMPLATE,
    Template,
    drop_unanswerable,
    first_batch,
    render_chat,
    select_prompts,
    with_chat,
    with_user_task,
)
from ..session import materialize
from ..sources import json_sources as src

EHRSQL_DB = "mimic_iv"


def _finish(df: DataFrame, phase: str, template: Template) -> DataFrame:
    if phase == "train":
        df = normalize_sql(df, "query", "answer")
    df = with_user_task(df)
    df = with_chat(df, phase)
    df = render_chat(df, add_generation_prompt=(phase != "train"), template=template)
    return select_prompts(df)


def pauq_prompts(samples: DataFrame, schemas: DataFrame, phase: str = "train", *, on_missing: OnMissing = "raise",
                 template: Template = DEFAULT_TEMPLATE, one_batch: int | None = None) -> DataFrame:
    """samples (ord, id, db_id, question, query) ⋈ schema strings by db_id."""
    s = samples.select("ord", "id", "db_id", "question", "query")
    if one_batch:  # the rows are chosen before anything is built for them
        if on_missing == "drop":
            s = s.join(schemas.select("db_id"), "db_id", "left_semi").select("ord", "id", "db_id", "question", "query")
        s = materialize(first_batch(s, one_batch))
    s = attach_schema(clean_questions(s, "question"), schemas, on_missing=on_missing)
    return _finish(s, phase, template)


def ehrsql_prompts(questions: DataFrame, labels: DataFrame, schemas: DataFrame, phase: str = "train", *,
                   db_id: str = EHRSQL_DB, on_missing: OnMissing = "raise", template: Template = DEFAULT_TEMPLATE,
                   one_batch: int | None = None) -> DataFrame:
    """questions (ord, id, question) ⋈ labels (id, sql); one fixed schema."""
    q = attach_labels(questions.select("ord", "id", "question"), labels, on_missing=on_missing)
    q = drop_unanswerable(q, phase, "sql").withColumnRenamed("sql", "query")
    if one_batch:  # the rows are chosen before anything is built for them
        q = materialize(first_batch(q, one_batch))
    q = attach_schema_const(clean_questions(q, "question"), schemas, db_id)
    return _finish(q, phase, template)


def read_corpus(spark: SparkSession, name: str, data_path: str, tables_path: str, phase: str = "train", *,
                one_batch: int | None = None, on_missing: OnMissing = "raise",
                template: Template = DEFAULT_TEMPLATE, fmt: str = "json") -> DataFrame:
    """Dataset dispatch by name; an unknown name is an error (the original
    silently returns an empty dataset).  ``fmt='parquet'`` reads the corpus
    and the catalog from copies written by ``ingest_json_array``."""
    return _corpus(spark, name, data_path, _catalog_strings(spark, tables_path, fmt), phase, one_batch=one_batch,
                   on_missing=on_missing, template=template, fmt=fmt)


def _catalog_strings(spark: SparkSession, tables_path: str, fmt: str = "json") -> DataFrame:
    return cat_ops.schema_strings(src.read_catalog(spark, tables_path, fmt=fmt))


def _corpus(spark: SparkSession, name: str, data_path: str, schemas: DataFrame, phase: str, *, one_batch: int | None = None,
            on_missing: OnMissing = "raise", template: Template = DEFAULT_TEMPLATE, fmt: str = "json") -> DataFrame:
    if name == "pauq":
        return pauq_prompts(src.read_pauq(spark, data_path, fmt=fmt), schemas, phase, on_missing=on_missing,
                            template=template, one_batch=one_batch)
    if name == "ehrsql":
        return ehrsql_prompts(src.read_ehrsql_questions(spark, data_path, fmt=fmt),
                              src.read_ehrsql_labels(spark, data_path, fmt=fmt),
                              schemas, phase, on_missing=on_missing, template=template, one_batch=one_batch)
    raise ValueError(f"unknown dataset name {name!r}; expected 'pauq' or 'ehrsql'")


def train_eval_prompts(spark: SparkSession, name: str, train_path: str, eval_path: str, tables_path: str,
                       **kw) -> DataFrame:
    """Training and evaluation sets, both built with phase ``train`` (as the
    original does), tagged by ``split``."""
    schemas = materialize(_catalog_strings(spark, tables_path, kw.get("fmt", "json")))
    tr = _corpus(spark, name, train_path, schemas, "train", **kw).withColumn("split", F.lit("train"))
    ev = _corpus(spark, name, eval_path, schemas, "train", **kw).withColumn("split", F.lit("eval"))
    return tr.unionByName(ev)
