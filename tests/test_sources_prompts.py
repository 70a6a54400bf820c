import json

import pytest
from pyspark.sql import functions as F

from conftest import F1_CATALOG, F1_GOLDEN
from sqlkiln import fixed
from sqlkiln.operators import catalog as C
from sqlkiln.plans.prompts import ehrsql_prompts, pauq_prompts, read_corpus, train_eval_prompts
from sqlkiln.sources import json_sources as src

F2_SAMPLES = [
    {"id": "TS_1", "db_id": "shop", "question": "\t‘Who’ ordered “most”?\n",
     "query": 'SELECT T1.name , count(*) FROM customer AS T1 JOIN orders AS T2 ON T1.cust_id = T2.cust_id '
              'WHERE T1.name = "Bob" ORDER BY count(*)'},
    {"id": "TS_2", "db_id": "flat", "question": "a\nb", "query": "SELECT a FROM t ORDER BY a , b"},
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "tables.json").write_text(json.dumps(F1_CATALOG))
    (d / "train.json").write_text(json.dumps(F2_SAMPLES))
    (d / "bad.json").write_text(json.dumps(F2_SAMPLES + [{"id": "TS_3", "db_id": "nowhere", "question": "q",
                                                          "query": "SELECT 1"}]))
    e1 = d / "ehr_obj"
    e1.mkdir()
    (e1 / "data.json").write_text(json.dumps({"version": "1", "data": [
        {"id": "1", "question": "q1"}, {"id": "2", "question": "q2"}, {"id": "3", "question": "q3"}]}))
    (e1 / "label.json").write_text('{"1": "select 1", "2": "null", "3": null}')
    e2 = d / "ehr_list"
    e2.mkdir()
    (e2 / "data.json").write_text(json.dumps([{"id": "1", "question": "q1"}]))
    (e2 / "label.json").write_text('{"1": "a", "1": "b"}')
    e3 = d / "ehr_missing"
    e3.mkdir()
    (e3 / "data.json").write_text(json.dumps([{"id": "1", "question": "q1"}, {"id": "9", "question": "q9"}]))
    (e3 / "label.json").write_text('{"1": "select 1"}')
    return d


def test_pauq_reader_keeps_order(spark, files):
    rows = src.read_pauq(spark, str(files / "train.json")).orderBy("ord").collect()
    assert [(r.ord, r.id) for r in rows] == [(0, "TS_1"), (1, "TS_2")]


def test_ehrsql_both_shapes(spark, files):
    a = [(r.ord, r.id, r.question) for r in src.read_ehrsql_questions(spark, str(files / "ehr_obj")).collect()]
    b = [(r.ord, r.id, r.question) for r in src.read_ehrsql_questions(spark, str(files / "ehr_list")).collect()]
    assert a[0] == b[0] == (0, "1", "q1")
    assert len(a) == 3


def test_labels_last_key_wins_and_null(spark, files):
    lab = {r.id: r.sql for r in src.read_ehrsql_labels(spark, str(files / "ehr_list")).collect()}
    assert lab == {"1": "b"}
    lab = {r.id: r.sql for r in src.read_ehrsql_labels(spark, str(files / "ehr_obj")).collect()}
    assert lab == {"1": "select 1", "2": "null", "3": None}


def _user(text):
    start = text.index("<|start_header_id|>user<|end_header_id|>\n\n") + len("<|start_header_id|>user<|end_header_id|>\n\n")
    return text[start:text.index("<|eot_id|>", start)]


def test_pauq_prompts_f5(spark, files):
    out = {r.id: r.text for r in read_corpus(spark, "pauq", str(files / "train.json"), str(files / "tables.json"),
                                                "train").collect()}
    # The rendered content is stripped, so the schema's two trailing newlines go.
    assert _user(out["TS_2"]) == "QUESTION: ab\nDATABASE SCHEMA: " + F1_GOLDEN["flat"].rstrip("\n")
    assert out["TS_2"].startswith(fixed.BOS + "<|start_header_id|>system<|end_header_id|>\n\nYou are text-to-SQL")
    assert out["TS_2"].endswith("<|start_header_id|>assistant<|end_header_id|>\n\n"
                                "select a from t order by a asc , b ;<|eot_id|>")
    assert "QUESTION: 'Who' ordered 'most'?" in out["TS_1"]


def test_pauq_test_phase_has_generation_header(spark, files):
    out = read_corpus(spark, "pauq", str(files / "train.json"), str(files / "tables.json"), "test").collect()
    for r in out:
        assert r.text.endswith("<|eot_id|>" + fixed.ASSISTANT_HEADER)
        assert r.text.count("<|start_header_id|>") == 3


def test_missing_db_raises(spark, files):
    with pytest.raises(Exception, match="no schema string"):
        read_corpus(spark, "pauq", str(files / "bad.json"), str(files / "tables.json"), "train").collect()


def test_ehrsql_train_drops_unanswerable(spark, files):
    tables = str(files / "tables.json")
    tr = read_corpus(spark, "ehrsql", str(files / "ehr_obj"), tables, "train").collect()
    te = read_corpus(spark, "ehrsql", str(files / "ehr_obj"), tables, "test").collect()
    assert [r.id for r in tr] == ["1"]
    assert sorted(r.id for r in te) == ["1", "2", "3"]
    # mimic_iv is not in the catalog: empty key lists, like the original.
    assert "DATABASE SCHEMA: Foreign_keys = []\n\nPrimary_keys = []" in tr[0].text


def test_missing_label_raises_in_both_phases(spark, files):
    for phase in ("train", "test"):
        with pytest.raises(Exception, match="no label"):
            read_corpus(spark, "ehrsql", str(files / "ehr_missing"), str(files / "tables.json"), phase).collect()


def test_unknown_dataset_raises(spark, files):
    with pytest.raises(ValueError):
        read_corpus(spark, "spider", str(files / "train.json"), str(files / "tables.json"))


def test_one_batch_after_filter(spark, files):
    out = read_corpus(spark, "pauq", str(files / "train.json"), str(files / "tables.json"), "train", one_batch=1)
    assert [r.id for r in out.collect()] == ["TS_1"]
    # The top-k ran before the prompts were built (see test_first_batch_is_top_k):
    # what is left reads the chosen rows and never the file.
    assert "train.json" not in out._jdf.queryExecution().executedPlan().toString()


def test_train_eval_union(spark, files):
    out = train_eval_prompts(spark, "pauq", str(files / "train.json"), str(files / "train.json"),
                             str(files / "tables.json"))
    assert sorted((r.split, r.id) for r in out.collect()) == [
        ("eval", "TS_1"), ("eval", "TS_2"), ("train", "TS_1"), ("train", "TS_2")]


def test_result_invariant_under_repartition(spark, files):
    cat = src.read_catalog(spark, str(files / "tables.json"))
    schemas = C.schema_strings(cat)
    samples = src.read_pauq(spark, str(files / "train.json"))
    a = sorted(r.text for r in pauq_prompts(samples, schemas, "train").collect())
    b = sorted(r.text for r in pauq_prompts(samples.repartition(5), schemas.repartition(3), "train").collect())
    assert a == b


def test_parquet_copies_give_same_prompts(spark, files, tmp_path):
    src.ingest_json_array(spark, str(files / "train.json"), str(tmp_path / "train.parquet"))
    src.ingest_json_array(spark, str(files / "tables.json"), str(tmp_path / "tables.parquet"), kind="catalog")
    a = sorted(read_corpus(spark, "pauq", str(files / "train.json"), str(files / "tables.json"), "train").collect())
    b = sorted(read_corpus(spark, "pauq", str(tmp_path / "train.parquet"), str(tmp_path / "tables.parquet"), "train",
                           fmt="parquet").collect())
    assert a == b


def test_ehrsql_parquet_copies_give_same_prompts(spark, files, tmp_path):
    src.ingest_json_array(spark, str(files / "ehr_obj"), str(tmp_path / "ehr"), kind="ehrsql")
    src.ingest_json_array(spark, str(files / "tables.json"), str(tmp_path / "tables.parquet"), kind="catalog")
    for phase in ("train", "test"):
        a = sorted(read_corpus(spark, "ehrsql", str(files / "ehr_obj"), str(files / "tables.json"), phase).collect())
        b = sorted(read_corpus(spark, "ehrsql", str(tmp_path / "ehr"), str(tmp_path / "tables.parquet"), phase,
                               fmt="parquet").collect())
        assert a == b and len(a) > 0
