import json

import pytest
from pyspark.sql import functions as F

from conftest import F1_CATALOG, F1_GOLDEN
from sqlkiln.operators import catalog as C
from sqlkiln.sources.json_sources import read_catalog


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("cat") / "tables.json"
    p.write_text(json.dumps(F1_CATALOG))
    return read_catalog(spark, str(p))


def test_read_catalog_types(cat):
    row = cat.filter("db_id = 'shop'").first()
    assert row.column_names_original[0] == ["-1", "*"]
    assert row.cat_ord == 0


def test_schema_strings_golden(cat):
    got = {r.db_id: r.schema_str for r in C.schema_strings(cat).collect()}
    assert got == F1_GOLDEN


def test_columns_stop_at_shorter(cat):
    cols = C.catalog_columns(cat).filter("db_id = 'shop'")
    names = [r.col for r in cols.orderBy("col_ord", "tbl_ord").collect()]
    assert "extra" not in names
    assert names[:2] == ["*", "*"]


def test_pk_on_star_is_last_table(cat):
    pk = C.catalog_primary_keys(cat).filter("db_id = 'star'").collect()
    assert [(r.tbl, r.col) for r in pk] == [("a", "*")]


def test_duplicate_db_concatenates(spark, tmp_path):
    entries = [F1_CATALOG[1], dict(F1_CATALOG[1], column_names_original=[[0, "b"]], column_types=["text"])]
    p = tmp_path / "dup.json"
    p.write_text(json.dumps(entries))
    got = C.schema_strings(read_catalog(spark, str(p))).collect()
    assert len(got) == 1
    assert got[0].schema_str.startswith("Table t, columns = [*,a,b]\n")


def test_numeric_db_id_stays_string(spark, tmp_path):
    p = tmp_path / "num.json"
    p.write_text(json.dumps([dict(F1_CATALOG[1], db_id="0042")]))
    got = C.schema_strings(read_catalog(spark, str(p))).collect()
    assert got[0].db_id == "0042"
    assert got[0].schema_str == F1_GOLDEN["flat"]


def test_pk_out_of_range_raises(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text(json.dumps([dict(F1_CATALOG[1], primary_keys=[7])]))
    with pytest.raises(Exception):
        C.catalog_primary_keys(read_catalog(spark, str(p))).collect()


def test_fk_on_star(spark, tmp_path):
    p = tmp_path / "fk.json"
    p.write_text(json.dumps([dict(F1_CATALOG[0], foreign_keys=[[0, 1]])]))
    fk = C.catalog_foreign_keys(read_catalog(spark, str(p))).collect()
    assert [(r.tbl1, r.col1, r.tbl2, r.col2) for r in fk] == [("customer", "*", "orders", "order_id")]


def test_missing_required_columns_raise(spark, tmp_path):
    e = dict(F1_CATALOG[1])
    del e["column_names"]
    p = tmp_path / "nocols.json"
    p.write_text(json.dumps([e]))
    with pytest.raises(Exception):
        read_catalog(spark, str(p)).collect()


def test_single_shuffle_equals_grouped(cat):
    a = sorted(C.schema_strings(cat).collect())
    b = sorted(C.schema_strings_grouped(cat).collect())
    assert a == b


def test_empty_entry_still_rendered(spark, tmp_path):
    p = tmp_path / "empty.json"
    p.write_text(json.dumps([dict(F1_CATALOG[1], db_id="void", table_names_original=[], column_names_original=[],
                                  column_types=[])]))
    got = C.schema_strings(read_catalog(spark, str(p))).collect()
    assert [(r.db_id, r.schema_str) for r in got] == [("void", "Foreign_keys = []\n\nPrimary_keys = []\n")]
