"""Schema-catalog operators: flatten the nested catalog and render one schema
string per database.

Input ``cat``: one row per catalog entry with ``db_id STRING,
table_names_original ARRAY<STRING>, column_names_original
ARRAY<ARRAY<STRING>>`` (``[table_idx, name]`` pairs read as strings),
``column_types ARRAY<STRING>, primary_keys ARRAY<BIGINT>, foreign_keys
ARRAY<ARRAY<BIGINT>>`` and optionally ``cat_ord`` (entry position; entries
sharing a ``db_id`` are concatenated in that order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EMPTY_KEYS = "[]\n"


def _cat_ord(cat: DataFrame) -> Column:
    return F.col("cat_ord") if "cat_ord" in cat.columns else F.lit(0).cast("long")


def _py_index(i: Column) -> Column:
    """0-based Python index (negatives count from the end) -> 1-based
    ``element_at`` index; out of range raises like Python's IndexError."""
    return F.when(i >= 0, i + 1).otherwise(i).cast("int")


def _table_at(tables: Column, i: Column) -> Column:
    return F.element_at(tables, _py_index(i))


def _column_at(cols: Column, pos: Column) -> Column:
    return F.element_at(cols, _py_index(pos))


def catalog_columns(cat: DataFrame) -> DataFrame:
    """(db_id, tbl, col, col_type, tbl_ord, col_ord, cat_ord).

    Columns are zipped with their types and stop at the shorter list; the
    ``[-1, '*']`` entry yields ``('*', 'text')`` for every table."""
    cols, types, tables = F.col("column_names_original"), F.col("column_types"), F.col("table_names_original")
    n = F.least(F.size(cols), F.size(types))
    zipped = F.arrays_zip(F.slice(cols, 1, n).alias("c"), F.slice(types, 1, n).alias("ty"))
    step = cat.select(
        "db_id", _cat_ord(cat).alias("cat_ord"), tables.alias("tables"),
        F.posexplode(zipped).alias("col_ord", "cz"),
    ).select(
        "db_id", "cat_ord", "tables", "col_ord",
        F.element_at("cz.c", 1).cast("int").alias("tbl_idx"),
        F.element_at("cz.c", 2).alias("name"),
        F.col("cz.ty").alias("ty"),
    )
    star = F.col("tbl_idx") == -1
    all_tables = F.when(F.size("tables") > 0, F.sequence(F.lit(0), F.size("tables") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return step.select(
        "db_id",
        F.explode(F.when(star, all_tables).otherwise(F.array("tbl_idx"))).alias("tbl_ord"),
        F.when(star, F.lit("*")).otherwise(F.col("name")).alias("col"),
        F.when(star, F.lit("text")).otherwise(F.col("ty")).alias("col_type"),
        "col_ord", "cat_ord", "tables",
    ).select(
        "db_id",
        _table_at(F.col("tables"), F.col("tbl_ord")).alias("tbl"),
        "col", "col_type",
        F.col("tbl_ord").cast("int").alias("tbl_ord"),
        F.col("col_ord").cast("int").alias("col_ord"),
        "cat_ord",
    )


def catalog_primary_keys(cat: DataFrame) -> DataFrame:
    """(db_id, tbl, col, pk_ord, cat_ord): key positions index the full,
    untruncated column list."""
    x = cat.select(
        "db_id", _cat_ord(cat).alias("cat_ord"), "table_names_original", "column_names_original",
        F.posexplode("primary_keys").alias("pk_ord", "pk"),
    ).withColumn("pair", _column_at(F.col("column_names_original"), F.col("pk")))
    return x.select(
        "db_id",
        _table_at(F.col("table_names_original"), F.element_at("pair", 1).cast("int")).alias("tbl"),
        F.element_at("pair", 2).alias("col"),
        F.col("pk_ord").cast("int").alias("pk_ord"),
        "cat_ord",
    )


def catalog_foreign_keys(cat: DataFrame) -> DataFrame:
    """(db_id, tbl1, col1, tbl2, col2, fk_ord, cat_ord)."""
    x = cat.select(
        "db_id", _cat_ord(cat).alias("cat_ord"), "table_names_original", "column_names_original",
        F.posexplode("foreign_keys").alias("fk_ord", "fk"),
    ).select(
        "*",
        _column_at(F.col("column_names_original"), F.element_at("fk", 1)).alias("p1"),
        _column_at(F.col("column_names_original"), F.element_at("fk", 2)).alias("p2"),
    )
    tables = F.col("table_names_original")
    return x.select(
        "db_id",
        _table_at(tables, F.element_at("p1", 1).cast("int")).alias("tbl1"),
        F.element_at("p1", 2).alias("col1"),
        _table_at(tables, F.element_at("p2", 1).cast("int")).alias("tbl2"),
        F.element_at("p2", 2).alias("col2"),
        F.col("fk_ord").cast("int").alias("fk_ord"),
        "cat_ord",
    )


def filter_db(df: DataFrame, db_id: str) -> DataFrame:
    return df.filter(F.col("db_id") == F.lit(db_id))


def render_tables(columns: DataFrame) -> DataFrame:
    """(db_id, tables_str): ``Table T, columns = [a,b]\\n`` per table, tables
    in code-point order, columns in catalog order."""
    lines = columns.groupBy("db_id", "tbl").agg(
        F.expr("listagg(col, ',') WITHIN GROUP (ORDER BY cat_ord, col_ord, tbl_ord)").alias("cl")
    ).select(
        "db_id", "tbl",
        F.concat(F.lit("Table "), F.col("tbl"), F.lit(", columns = ["), F.col("cl"), F.lit("]\n")).alias("line"),
    )
    return lines.groupBy("db_id").agg(
        F.expr("listagg(line, '') WITHIN GROUP (ORDER BY tbl)").alias("tables_str")
    )


def render_foreign_keys(fks: DataFrame) -> DataFrame:
    """(db_id, fk_str): ``[a.x = b.y,...]`` with no newline; databases with
    no key get ``[]\\n`` when joined in ``schema_strings``."""
    item = F.concat_ws("", "tbl1", F.lit("."), "col1", F.lit(" = "), "tbl2", F.lit("."), "col2")
    return fks.select("db_id", "cat_ord", "fk_ord", item.alias("item")).groupBy("db_id").agg(
        F.concat(F.lit("["), F.expr("listagg(item, ',') WITHIN GROUP (ORDER BY cat_ord, fk_ord)"), F.lit("]")).alias(
            "fk_str"
        )
    )


def render_primary_keys(pks: DataFrame) -> DataFrame:
    """(db_id, pk_str): ``[t.c,...]\\n``."""
    item = F.concat_ws("", "tbl", F.lit("."), "col")
    return pks.select("db_id", "cat_ord", "pk_ord", item.alias("item")).groupBy("db_id").agg(
        F.concat(F.lit("["), F.expr("listagg(item, ',') WITHIN GROUP (ORDER BY cat_ord, pk_ord)"), F.lit("]\n")).alias(
            "pk_str"
        )
    )


def assemble_schema(dbs: DataFrame, tables: DataFrame, fks: DataFrame, pks: DataFrame) -> DataFrame:
    """tables + ``Foreign_keys = `` + fk + ``\\n`` + ``Primary_keys = `` + pk."""
    j = dbs.join(tables, "db_id", "left").join(fks, "db_id", "left").join(pks, "db_id", "left")
    return j.select(
        "db_id",
        F.concat(
            F.coalesce("tables_str", F.lit("")),
            F.lit("Foreign_keys = "), F.coalesce("fk_str", F.lit(EMPTY_KEYS)), F.lit("\n"),
            F.lit("Primary_keys = "), F.coalesce("pk_str", F.lit(EMPTY_KEYS)),
        ).alias("schema_str"),
    )


def schema_strings_grouped(cat: DataFrame) -> DataFrame:
    """(db_id, schema_str) from the three exploded tables with one aggregate
    per part (kept as a cross-check of ``schema_strings``)."""
    dbs = cat.select("db_id").distinct()
    return assemble_schema(
        dbs,
        render_tables(catalog_columns(cat)),
        render_foreign_keys(catalog_foreign_keys(cat)),
        render_primary_keys(catalog_primary_keys(cat)),
    )


def _entry_items(cat: DataFrame) -> Column:
    """Render items of one catalog entry, built where the entry lies:
    ``struct(kind, tbl, k1, k2, k3, txt)`` with kind -1 = entry marker,
    0 = column (star expanded to every table), 1 = foreign key, 2 = primary
    key; (k1, k2, k3) = (entry, position, table index)."""
    tables, cols, types = F.col("table_names_original"), F.col("column_names_original"), F.col("column_types")
    co = _cat_ord(cat).cast("long")
    n = F.least(F.size(cols), F.size(types))

    def item(kind, tbl, k2, k3, txt):
        return F.struct(F.lit(kind).alias("kind"), tbl.alias("tbl"), co.alias("k1"), k2.cast("int").alias("k2"),
                        k3.cast("int").alias("k3"), txt.alias("txt"))

    def col_items(c, j):
        ti = F.element_at(c, 1).cast("int")
        every = F.when(F.size(tables) > 0, F.sequence(F.lit(0), F.size(tables) - 1)).otherwise(
            F.array().cast("array<int>"))
        star = F.transform(every, lambda t: item(0, F.element_at(tables, t + 1), j, t, F.lit("*")))
        one = F.array(item(0, _table_at(tables, ti), j, ti, F.element_at(c, 2)))
        return F.when(ti == -1, star).otherwise(one)

    def ref(pos):
        pair = _column_at(cols, pos)
        return F.concat(_table_at(tables, F.element_at(pair, 1).cast("int")), F.lit("."), F.element_at(pair, 2))

    columns = F.flatten(F.transform(F.slice(cols, 1, n), col_items))
    fks = F.transform("foreign_keys", lambda f, j: item(
        1, F.lit(""), j, F.lit(0), F.concat(ref(F.element_at(f, 1)), F.lit(" = "), ref(F.element_at(f, 2)))))
    pks = F.transform("primary_keys", lambda p, j: item(2, F.lit(""), j, F.lit(0), ref(p)))
    marker = F.array(item(-1, F.lit(""), F.lit(0), F.lit(0), F.lit("")))
    return F.concat(marker, columns, fks, pks)


def schema_strings(cat: DataFrame) -> DataFrame:
    """(db_id, schema_str), one row per distinct ``db_id``: one scan of the
    catalog and one shuffle.

    Each entry's columns, foreign keys and primary keys become render items
    in a single projection; the items are gathered once per database (entries
    sharing a ``db_id`` merge here) and sorted by (kind, table, entry,
    position), which puts tables in code-point order and their columns in
    catalog order; the text is then rendered row-locally with array
    functions.  A group is one database's schema, bounded by its own text.
    """
    g = cat.select("db_id", _entry_items(cat).alias("items")).groupBy("db_id").agg(
        F.array_sort(F.flatten(F.collect_list("items"))).alias("xs"))

    def texts(kind):
        return F.transform(F.filter("xs", lambda x: x["kind"] == kind), lambda x: x["txt"])

    col_items = F.filter("xs", lambda x: x["kind"] == 0)
    tables = F.array_distinct(F.transform(col_items, lambda x: x["tbl"]))
    lines = F.transform(tables, lambda t: F.concat(
        F.lit("Table "), t, F.lit(", columns = ["),
        F.array_join(F.transform(F.filter(col_items, lambda x: x["tbl"] == t), lambda x: x["txt"]), ","),
        F.lit("]\n")))
    fk = F.when(F.size(texts(1)) == 0, F.lit(EMPTY_KEYS)).otherwise(
        F.concat(F.lit("["), F.array_join(texts(1), ","), F.lit("]")))
    pk = F.when(F.size(texts(2)) == 0, F.lit(EMPTY_KEYS)).otherwise(
        F.concat(F.lit("["), F.array_join(texts(2), ","), F.lit("]\n")))
    return g.select("db_id", F.concat(F.array_join(lines, ""), F.lit("Foreign_keys = "), fk, F.lit("\n"),
                                      F.lit("Primary_keys = "), pk).alias("schema_str"))


def empty_schema_string() -> str:
    """What a database missing from the catalog renders to."""
    return "Foreign_keys = " + EMPTY_KEYS + "\n" + "Primary_keys = " + EMPTY_KEYS
