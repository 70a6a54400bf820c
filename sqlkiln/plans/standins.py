"""Text-to-SQL inputs derived from the driver's tables.

The driver ships no text-to-SQL corpus, so every registered query derives its
input here from whole tables; ``sqlkiln.oracle`` derives the very same input
in DuckDB SQL.  Nothing is sampled or capped.

* catalog: database = ``p_brand``, table = ``p_type``, column = distinct
  ``p_name`` inside (brand, type) ordered by its first ``p_partkey``.  The
  distinct step is a map-side pre-aggregation, so the catalog stays bounded by
  the name vocabulary however large ``part`` grows.  Each table's first column
  is its primary key; each table's key refers to the previous table's key.
* samples: one per document; ``db_id`` = brand named by the document source,
  question = the whole text, gold SQL from a per-language template.
* labels: one per ``labels`` row; ``'null'`` (unanswerable) when quality is 0.
* gold SQL for normalisation: one per ``part`` row, template per ``p_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- catalog -------------------------------------------------------------

def col_type_rule(name: Column) -> Column:
    return F.when(name.endswith(" bolt") | name.endswith(" rod"), F.lit("number")).otherwise(F.lit("text"))


def catalog_from_part(part: DataFrame) -> DataFrame:
    """Nested catalog rows in the ``tables.json`` shape, one per brand.

    One partially aggregated ``groupBy`` collapses ``part`` to its distinct
    (brand, type, name) columns; a second gathers each brand's columns
    (bounded by the name vocabulary) and everything else is row-local:
    tables in order of first appearance, the first column of each table is
    its key, each key refers to the previous table's key."""
    names = part.groupBy(
        F.col("p_brand").alias("db_id"), F.col("p_type").alias("tbl"), F.col("p_name").alias("col")
    ).agg(F.min("p_partkey").alias("k"))
    per_db = names.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("k", "tbl", "col"))).alias("cols"))
    tables = F.array_distinct(F.transform("cols", lambda x: x["tbl"]))
    col_tables = F.transform("cols", lambda x: x["tbl"])
    x = per_db.select("db_id", "cols", tables.alias("tables"), col_tables.alias("col_tables"))
    pks = F.transform("tables", lambda t: F.array_position("col_tables", t))
    x = x.select("*", pks.alias("pks"))
    return x.select(
        "db_id",
        F.col("tables").alias("table_names_original"),
        F.concat(
            F.array(F.array(F.lit("-1"), F.lit("*"))),
            F.transform("cols", lambda c: F.array((F.array_position("tables", c["tbl"]) - 1).cast("string"), c["col"])),
        ).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), F.transform("cols", lambda c: col_type_rule(c["col"]))).alias("column_types"),
        F.col("pks").alias("primary_keys"),
        F.when(
            F.size("pks") >= 2,
            F.transform(F.sequence(F.lit(2), F.size("pks")),
                        lambda i: F.array(F.element_at("pks", i), F.element_at("pks", i - 1))),
        ).otherwise(F.array().cast("array<array<bigint>>")).alias("foreign_keys"),
        F.lit(0).cast("long").alias("cat_ord"),
    )


# --- samples, labels -----------------------------------------------------

def doc_id_str(c: Column) -> Column:
    return F.concat(F.lit("TS_"), c.cast("string"))


def source_db(source: Column) -> Column:
    return F.concat(F.lit("Brand#"), (F.substring(source, 4, 1 << 20).cast("int") + 1).cast("string"))


def sample_sql(lang: Column, source: Column, n_chars: Column) -> Column:
    n = n_chars.cast("string")
    return (
        F.when(lang == "en", F.concat(
            F.lit('SELECT T1.lang , count(*) FROM documents AS T1 JOIN labels AS T2 ON T1.doc_id = T2.doc_id '
                  'WHERE T1.source = "'), source, F.lit('" ORDER BY count(*)')))
        .when(lang == "fr", F.concat(F.lit("select doc_id from documents where n_chars > "), n,
                                     F.lit(" order by doc_id desc;")))
        .when(lang == "de", F.lit("SELECT source FROM documents ORDER BY source , n_chars"))
        .otherwise(F.concat(F.lit("SELECT description FROM documents AS T1 WHERE T1.n_chars >= "), n,
                            F.lit(" ORDER BY T1.doc_id")))
    )


def samples_from_documents(documents: DataFrame) -> DataFrame:
    """(ord, id, db_id, question, query)."""
    return documents.select(
        F.col("doc_id").alias("ord"),
        doc_id_str(F.col("doc_id")).alias("id"),
        source_db(F.col("source")).alias("db_id"),
        F.col("text").alias("question"),
        sample_sql(F.col("lang"), F.col("source"), F.col("n_chars")).alias("query"),
    )


def questions_from_documents(documents: DataFrame) -> DataFrame:
    """(ord, id, question)."""
    return documents.select(F.col("doc_id").alias("ord"), doc_id_str(F.col("doc_id")).alias("id"),
                            F.col("text").alias("question"))


def labels_from_labels(labels: DataFrame) -> DataFrame:
    """(id, sql); ``'null'`` marks an unanswerable question."""
    sql = F.when(F.col("quality") == 0, F.lit("null")).otherwise(F.concat(
        F.lit("SELECT count(*) FROM documents AS T1 WHERE T1.doc_id = "), F.col("doc_id").cast("string"),
        F.lit(" AND T1.toxic = "), F.col("toxic").cast("string")))
    return labels.select(doc_id_str(F.col("doc_id")).alias("id"), sql.alias("sql"))


# --- gold SQL for the normalisation checks -------------------------------

def part_sql(part: DataFrame) -> DataFrame:
    """(id, sql): one raw query per part row, template chosen by type."""
    w1 = F.element_at(F.split("p_name", " "), 1)
    w2 = F.element_at(F.split("p_name", " "), 2)
    size = F.col("p_size").cast("string")
    tbl = F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))
    t = F.col("p_type")
    sql = (
        F.when(t == "ECONOMY", F.concat(
            F.lit("SELECT T1."), w1, F.lit(" , count(*) FROM "), tbl,
            F.lit(" AS T1 JOIN orders AS T2 ON T1.p_partkey = T2.o_custkey WHERE T1."), w2,
            F.lit(' = "'), F.col("p_name"), F.lit('" ORDER BY count(*)')))
        .when(t == "LARGE", F.concat(F.lit("select "), w1, F.lit(" from part order by "), w2, F.lit(" desc;")))
        .when(t == "MEDIUM", F.concat(F.lit("SELECT "), w1, F.lit(" FROM part ORDER BY "), w1, F.lit(" , "), w2))
        .when(t == "PROMO", F.concat(
            F.lit("SELECT description , T1.* FROM part T1 WHERE p_size = "), size,
            F.lit(" AND p_comment = 'It T1' ORDER BY "), w2))
        .when(t == "SMALL", F.concat(
            F.lit("  SELECT "), w1, F.lit(" FROM "), w2, F.lit(" AS T1 WHERE T1.p_size >= "), size, F.lit("\u001c")))
        .otherwise(F.concat(
            F.lit("select Имя , "), w1, F.lit(" from Город as t1 join "), w2,
            F.lit(" as t10 on t1.p_partkey = t10.p_size order by Имя")))
    )
    return part.select(F.col("p_partkey").alias("id"), sql.alias("sql"))
