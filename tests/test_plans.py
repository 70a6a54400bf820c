"""Plan shape checks: broadcast where the side is measured small, top-k for
one-batch mode, pushdown and pruning at the scan, no Python in the text jobs,
no single-partition window over data."""

import pytest

from sqlkiln.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_schema_broadcasts(spark):
    p = plan(QUERIES["attach_schema"](spark, SF))
    assert "BroadcastHashJoin" in p
    assert "SortMergeJoin" not in p


@pytest.mark.parametrize("name", ["clean_questions", "normalize_sql", "schema_strings", "build_prompts_train",
                                  "catalog_columns", "step_entropy", "truncate_scores"])
def test_no_python_in_native_jobs(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p


def test_first_batch_is_top_k(spark):
    """The rows are chosen by a top-k; prompts are built for those alone."""
    from sqlkiln.operators.prompts import first_batch

    rows = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id as ord", "text")
    assert "TakeOrderedAndProject" in plan(first_batch(rows, 4))
    built = plan(QUERIES["first_batch"](spark, SF))
    assert "Exchange" not in built and "Join" not in built and "documents" not in built


def test_constant_schema_and_counts_join_nothing_twice(spark):
    assert "NestedLoop" not in plan(QUERIES["ehrsql_prompts_train"](spark, SF))
    counts = plan(QUERIES["prompt_counts"](spark, SF))
    assert "NestedLoop" not in counts and counts.count("documents.parquet") == 1


def test_json_texts_do_not_meet_in_one_task(spark, tmp_path):
    from sqlkiln.sources import json_sources

    for i in range(3):
        (tmp_path / f"{i}.json").write_text('[{"id": "%d", "db_id": "d", "question": "q", "query": "s"}]' % i)
    df = json_sources.read_pauq(spark, str(tmp_path))
    assert [r["id"] for r in df.orderBy("ord").collect()] == ["0", "1", "2"]
    assert "SinglePartition" not in plan(df)


def test_truncation_reaches_the_text(spark):
    assert "substring" in plan(QUERIES["truncate"](spark, SF)).lower()
    assert "ArrowEval" not in plan(QUERIES["max_len"](spark, SF))


def test_scan_prunes_columns(spark):
    p = plan(QUERIES["schema_strings"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string,p_type:string>" in p


def test_catalog_preaggregates(spark):
    p = plan(QUERIES["catalog_columns"](spark, SF))
    assert "partial_min" in p


def test_last_by_id_partial(spark):
    p = plan(QUERIES["last_by_id"](spark, SF))
    assert "partial_max_by" in p or "ObjectHashAggregate" in p or "SortAggregate" in p


def test_batch_ids_no_global_window(spark):
    from sqlkiln.operators.ordering import with_batch_id

    df = spark.range(0, 100, 1, 4).withColumnRenamed("id", "ord")
    p = plan(with_batch_id(df, 7))
    # The data itself is range-partitioned and checkpointed; the only window
    # runs over the per-partition count table (one row per partition).
    assert p.count("Window [") == 1
    assert "row_number" not in p


def test_filters_reach_the_scan(spark):
    p = plan(QUERIES["union_batches"](spark, SF))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_constant_schema_filter_pushed_into_part_scan(spark):
    # attach_schema_const materialises this filtered side; its plan pushes
    # the database filter through the catalog aggregation into the scan.
    from pyspark.sql import functions as F

    from sqlkiln.operators import catalog as C
    from sqlkiln.plans import standins as S

    schemas = C.schema_strings(S.catalog_from_part(S.table(spark, SF, "part")))
    p = plan(schemas.filter(F.col("db_id") == "Brand#1"))
    assert "EqualTo(p_brand,Brand#1)" in p
